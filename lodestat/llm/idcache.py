"""Token ids of text parts by 64-bit hash, as sorted arrays kept between the batches of one Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices begin[k] .. begin[k] + counts[k] - 1 of every k, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)


class IdCache:
    """At most ``limit`` parts are held; beyond it the table starts anew, which costs time only."""

    def __init__(self, limit: int):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def lookup(self, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in turn, number of ids of each). ``encode`` gets the index of one part per new hash and returns the
        numbers of ids and the ids."""
        keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) + new.sum() > self.limit:
                self._clear()
                new[:] = True
            counts, ids = encode(at[new])
            all_counts = np.concatenate([np.diff(self.first), counts])
            begin = np.cumsum(all_counts) - all_counts
            all_keys, all_ids = np.concatenate([self.keys, keys[new]]), np.concatenate([self.ids, ids])
            order = np.argsort(all_keys)
            self.ids = all_ids[spread(begin[order], all_counts[order])]
            self.first = np.concatenate([[0], np.cumsum(all_counts[order])])
            self.keys = all_keys[order]
            place = np.searchsorted(self.keys, keys)
        counts = np.diff(self.first)[place][inverse]
        return self.ids[spread(self.first[place][inverse], counts)], counts
