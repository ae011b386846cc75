"""Packing of tokenised documents into sequences of fixed capacity: dominance reduction, then best fit of what is left.

Only the number of pieces of each length decides, so the plan is made on a histogram of at most ``capacity`` counts, however many
documents there are; pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.idcache import IdCache
from lodestat.llm.words import chunks, split
from lodestat.session import checkpointed

CAPACITY = 2048
CACHED_PARTS = 1_500_000
ROWS_PER_PART = 100_000
_TAIL, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,!?;:"]] = True
_ALPHA[[*range(65, 91), *range(97, 123)]] = True


class WordTokens:
    """Token ids of words by hash, kept between batches of one Python worker, up to a fixed number of words.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its words in turn. A
    closing mark after an ASCII letter is a word of its own to it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = IdCache(CACHED_PARTS)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return counts, np.fromiter((i for ids in got for i in ids), np.uint32, int(counts.sum()))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end)."""
        words = split(texts)
        last = words.ends - 1
        cut = _TAIL[words.data[last]] & (last > words.starts) & _ALPHA[words.data[np.maximum(last - 1, 0)]]
        words.starts = np.insert(words.starts, np.flatnonzero(cut) + 1, last[cut])
        words.ends = np.insert(words.ends, np.flatnonzero(cut), last[cut])
        words.first = np.searchsorted(words.starts, words.offsets)
        hashes = words.hashes(lower=True)
        # special tokens are known by their exact letters; a word that may hold one must not share the lower-case key
        for at in np.flatnonzero(words.data[:-1] * (words.data[1:] == ord("|")) == ord("<")) if len(words.data) else ():
            k = int(np.searchsorted(words.starts, at, "right")) - 1
            hashes[k] = zlib.crc32(words.data[words.starts[k] : words.ends[k]].tobytes()) ^ (hashes[k] << np.uint64(32))
        def encode(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._encode([words.data[a:b].tobytes().decode() for a, b in zip(words.starts[at], words.ends[at], strict=True)])

        ids, counts = self.cache.lookup(hashes, encode)
        return ids, np.concatenate([[0], np.cumsum(counts)])[words.first]


@cache
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is its token ids and then id 0; only longer ones are cut, every ``capacity`` ids. A null or empty text is the one
    id 0. ``tokenizer`` is the path of a lower-casing word BPE in the tokenizers library's format, readable on every executor.
    """
    kinds = [("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    kinds += [("ids", T.ArrayType(T.IntegerType()))] * ids
    names = [k for k, _ in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in chunks(batches):
            flat, ends = tokens(batch.column("text"))
            row, piece, length, crc, slices = [], [], [], [], []
            for r in range(batch.num_rows):
                own = np.append(flat[ends[r] : ends[r + 1]], np.uint32(0)).astype("<u4")
                for p, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    row.append(r)
                    piece.append(p)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if ids:
                        slices.append(part)
            piece_ = np.array(piece, np.int32)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())).cast(pa.int64()), pa.array(piece_), pa.array(piece_.astype(np.int64) * capacity)]
            columns += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if ids:
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(slices).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(n, k) for n, k in kinds])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Stock:
    """Counts by size with ordered access to the sizes left; one item may be set aside."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def left(self, size: int, aside: int) -> int:
        return self.counts.get(size, 0) - (size == aside)

    def largest(self, limit: int, aside: int, also: int = 0) -> int:
        """The largest size up to limit of which there is one besides ``aside`` and ``also``; 0 if none."""
        k = bisect_right(self.sizes, limit) - 1
        while k >= 0 and self.left(self.sizes[k], aside) - (self.sizes[k] == also) < 1:
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def smallest(self, how_many: int, aside: int, above: int = 0) -> list[int]:
        out: list[int] = []
        for s in self.sizes[bisect_right(self.sizes, above) :]:
            out += [s] * min(self.left(s, aside), how_many - len(out))
            if len(out) == how_many:
                break
        return out


def _dominating(stock: _Stock, size: int, capacity: int) -> list[int] | None:
    """Items that, with one of ``size``, form a set that dominates every other set with that item; None if none is known.

    A set dominates another if the other's items can be shared out so that each share fits in one item of the first. Then some
    best packing holds the first set, and it can be fixed.
    """
    room = capacity - size
    k = stock.largest(room, size)
    if not k:
        return []
    if k == room:
        return [k]
    small = stock.smallest(3, size)
    if len(small) < 2 or small[0] + small[1] > room:
        return [k]
    if len(small) == 3 and sum(small) <= room:
        return None
    # at most two more items fit
    best, p = 0, k
    while p:
        q = stock.largest(min(room - p, p), size, p)
        best = max(best, p + q if q else 0)
        if 2 * p <= best:
            break
        p = stock.largest(p - 1, size)
    if k >= best:
        return [k]
    q = stock.largest(room - k, size, k)
    if q:
        over = stock.smallest(2, size, above=q)
        if len(over) < 2 or sum(over) > room:
            return [k, q]
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Martello-Toth reduction: (fixed patterns with their numbers of bins, counts left)."""
    stock, fixed = _Stock(counts), []
    again = True
    while again:
        again = False
        for size in stock.sizes[::-1]:
            while stock.counts.get(size, 0) and (others := _dominating(stock, size, capacity)) is not None:
                pattern: dict[int, int] = {}
                for s in [size, *others]:
                    pattern[s] = pattern.get(s, 0) + 1
                bins = min(stock.counts[s] // c for s, c in pattern.items())
                for s, c in pattern.items():
                    stock.take(s, c * bins)
                fixed.append((pattern, bins))
                again = True
    return fixed, stock.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit by decreasing size, on groups of bins with the same content."""
    room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            r = next((r for r in range(size, capacity) if room[r]), None)
            pattern, bins = room[r].pop() if r is not None else ({}, -(-n // (capacity // size)))
            r = capacity if r is None else r
            each = r // size
            full = min(bins, n // each)
            if full:
                room[r - each * size].append(({**pattern, size: each}, full))
            n -= full * each
            if n and full < bins:
                room[r - n * size].append(({**pattern, size: n}, 1))
                n, full = 0, full + 1
            if full < bins and pattern:
                room[r].append((pattern, bins - full))
    return [g for groups in room for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (size to copies) with their numbers of sequences; together they hold every piece once."""
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, offset, copies), ordered: where the pieces of a length go, by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, bins in patterns:
        offset = 0
        for size, copies in pattern.items():
            rows.append((size, used.get(size, 0), sequence, offset, copies))
            used[size] = used.get(size, 0) + copies * bins
            offset += size * copies
        sequence += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table


def place(rows: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``rows`` (each with a ``length`` from 1 to capacity) with sequence_id and offset; offsets of a sequence have no gaps.

    ``rows`` is read several times, so pass a checkpoint. A piece's rank among those of its length is its rank in its part plus
    the parts before; parts are hashes of the keys, so one frequent length is spread over all of them. Rows equal in all keys are
    interchangeable. No rows give no rows.
    """
    histogram = {int(r.length): int(r.n) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan(histogram, capacity))
    parts = max(1024, sum(histogram.values()) // ROWS_PER_PART)
    parted = rows.withColumn("part_", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    sums = parted.groupBy("part_", "length").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part_").alias("p_"), F.col("length").alias("l_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("part_", "length").orderBy(*keys)
    ranked = parted.withColumn("rank_", F.row_number().over(inside) - 1)
    ranked = ranked.join(sums, (ranked.part_ == sums.p_) & (ranked.length == sums.l_)).withColumn("rank_", F.col("rank_") + F.col("before_"))
    kept = [f for f in rows.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = int(slots[:, 1].max(initial=0)) + int(slots[:, 4].max(initial=0)) + 1
        wide = base.bit_length() + 12 < 63
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank_").to_numpy()
            if wide:
                at = np.searchsorted(slots[:, 0] * base + slots[:, 1], length * base + np.minimum(rank, base - 1), "right") - 1
            else:
                at = np.array([bisect_right(slots, (int(n), int(r)), key=lambda s: (s[0], s[1])) - 1 for n, r in zip(length, rank, strict=True)], np.int64)
            t, copies = rank - slots[at, 1], slots[at, 4]
            found = pa.array(slots[at, 2] + t // copies), pa.array(slots[at, 3] + t % copies * length)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank_").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(checkpointed(pieces(docs, tokenizer, capacity, ids)), capacity)
