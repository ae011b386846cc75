"""SentencePiece encoding and decoding by suffix-array matching.

The distinct parts of a batch's texts stand in one concatenated text. Its suffix array is searched for every piece of the
vocabulary at once; the ranges found are the edges (start, end, piece). Edges are sorted by part, merge priority and position and
relaxed: the first edge of a part that joins exactly two neighbouring symbols is applied, until none is left. That is the result
of the byte-pair merges of such a model, without a merge table.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns
from lodestat.llm.idcache import IdCache, spread
from lodestat.llm.words import mix, range_hashes

CACHED_PARTS = 1_000_000
LONG_PART = 64
BATCH_CHARS = 400_000
_MARK = 0x2581  # stands for a space
_STOP, _NUL, _HIGH = 0x110000, 0x10FFFF, 0x1FFFFF


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` codes, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
        if rank.max(initial=0) == len(rank):
            break
    return np.argsort(rank, kind="stable")


class Pieces:
    """A BPE model's vocabulary in the order binary search needs."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.single = {texts[i]: i for i in plain if len(texts[i]) == 1}
        several = sorted((i for i in plain if len(texts[i]) > 1), key=lambda i: texts[i])
        self.depth = max((len(texts[i]) for i in several), default=1)
        self.ids = np.array(several, np.int64)
        self.lengths = np.array([len(texts[i]) for i in several], np.int64)
        score = np.array([model.get_score(i) for i in range(size)])
        self.priority = np.unique(-score[self.ids], return_inverse=True)[1] if len(several) else self.ids
        grid = np.zeros((len(several), self.depth), np.uint32)
        high = np.full((len(several), self.depth), _HIGH, np.uint32)
        for row, i in enumerate(several):
            grid[row, : len(texts[i])] = high[row, : len(texts[i])] = _code_points(texts[i])
        self.low, self.high = self._strings(grid), self._strings(high)
        self.inside = np.zeros(0x110001, bool)  # code points of pieces of several: any other stands alone
        for i in several:
            self.inside[_code_points(texts[i])] = True
        self.one = np.full(0x110001, -1, np.int32)
        for text, i in self.single.items():
            self.one[ord(text)] = i
        self.byte = {int(texts[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        spoken = [
            b"" if model.is_control(i) else bytes([int(texts[i][3:5], 16)]) if model.is_byte(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else texts[i].replace("▁", " ").encode()
            for i in range(size)
        ]
        self.spoken_first = np.concatenate([[0], np.cumsum([len(b) for b in spoken])])
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.cache = IdCache(CACHED_PARTS)

    def _strings(self, grid: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(grid).view(f"<U{self.depth}").ravel()

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece number) of every occurrence of every piece of several code points, by binary search in the suffix array."""
        order = suffix_array(codes, self.depth)
        padded = np.concatenate([codes, np.full(self.depth, _STOP, np.uint32)])
        ranked = self._strings(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[order])
        left, right = np.searchsorted(ranked, self.low, "left"), np.searchsorted(ranked, self.high, "right")
        counts = right - left
        return order[spread(left, counts)], np.repeat(np.arange(len(counts)), counts)

    def _merge_long(self, start: int, end: int, by_span: dict[tuple[int, int], int], border: np.ndarray) -> None:
        """The same relaxation of one long part with a heap."""
        after = list(range(1, end - start + 1))
        before = list(range(-1, end - start - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < end - start and (p := by_span.get((start + a, start + after[b]))) is not None:
                heapq.heappush(heap, (p, a, b, after[b]))

        alive = [True] * (end - start)
        for a in range(end - start - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not alive[a] or not (b < end - start and alive[b]) or after[a] != b or after[b] != c:
                continue
            alive[b] = False
            border[start + b] = False
            after[a] = c
            if c < end - start:
                before[c] = a
            offer(before[a], a)
            offer(a, c)

    def encode_parts(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each part, ids) of parts given as code points."""
        sizes = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        codes = np.full(int((sizes + 1).sum()), _STOP, np.uint32)
        codes[spread(first, sizes)] = np.concatenate(parts)
        original = codes.copy()
        codes[codes == 0] = _NUL
        start, piece = self.edges(codes)
        end = start + self.lengths[piece]
        part = np.searchsorted(first, start, "right") - 1
        border = np.ones(len(codes) + 1, bool)
        long = sizes[part] > LONG_PART
        for k in np.unique(part[long]):
            mine = part == k
            by_span = dict(zip(zip(start[mine].tolist(), end[mine].tolist(), strict=True), self.priority[piece[mine]].tolist(), strict=True))
            self._merge_long(int(first[k]), int(first[k] + sizes[k]), by_span, border)
        order = np.flatnonzero(~long)
        order = order[np.lexsort((start[order], self.priority[piece[order]], part[order]))]
        s, e, p = start[order], end[order], part[order]
        while len(s):
            alive = border[s] & border[e]
            s, e, p = s[alive], e[alive], p[alive]
            if not len(s):
                break
            sums = np.zeros(len(border) + 1, np.int32)
            np.cumsum(border, out=sums[1:])
            fits = np.flatnonzero(sums[e] - sums[s + 1] == 1)
            if not len(fits):
                break
            best = fits[np.concatenate([[True], p[fits][1:] != p[fits][:-1]])]
            inner = np.searchsorted(sums, sums[s[best] + 1] + 1) - 1  # the one border between start and end
            border[inner] = False
        used = np.flatnonzero(border[:-1] & (original != _STOP))
        where = np.searchsorted(first, used, "right") - 1
        stop = np.concatenate([used[1:], [0]])
        last = np.concatenate([where[1:] != where[:-1], [True]]) if len(used) else np.zeros(0, bool)
        stop[last] = first[where[last]] + sizes[where[last]]
        ids = self.one[np.minimum(original[used], 0x110000)].astype(np.int64)
        joined = np.flatnonzero(stop - used > 1)
        if len(joined):
            span = np.int64(len(codes) + 1)
            names = start * span + start + self.lengths[piece]
            rank = np.argsort(names)
            ids[joined] = self.ids[piece[rank[np.searchsorted(names[rank], used[joined] * span + stop[joined])]]]
        counts = np.ones(len(used), np.int64)
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            spelled = [[self.byte.get(b, self.unknown) for b in chr(c).encode()] if self.byte else [self.unknown] for c in original[used[missing]]]
            counts[missing] = [len(x) for x in spelled]
            out = np.repeat(ids, counts)
            out[spread((np.cumsum(counts) - counts)[missing], counts[missing])] = [i for x in spelled for i in x]
            ids = out
        return np.bincount(where, counts, len(parts)).astype(np.int64), ids.astype(np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end)."""
        marked = ["▁" + t if t else "" for t in texts]
        first = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        codes = _code_points("".join(marked)).copy()
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        codes[codes == 0x20] = _MARK
        alone = ~self.inside[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = alone[1:] | alone[:-1] | ((codes[1:] == _MARK) & (codes[:-1] != _MARK))
        cut[first[:-1][first[:-1] < len(codes)]] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate([starts[1:], [len(codes)]])
        hashes = mix(range_hashes(mix(codes.astype(np.uint64), 0xA24BAED4963EE407), starts, ends, 0x9FB21C651E98DF25) + (ends - starts).astype(np.uint64))

        def encode(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.cumsum(ends[at] - starts[at])
            groups = np.split(at, np.flatnonzero(np.diff(sizes // BATCH_CHARS)) + 1)
            done = [self.encode_parts([codes[a:b] for a, b in zip(starts[g], ends[g], strict=True)]) for g in groups]
            return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

        ids, counts = self.cache.lookup(hashes, encode)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, first)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Texts of the ids first[k]:first[k + 1]; bytes that are no UTF-8 become U+FFFD."""
        known = np.where((ids < len(self.spoken_first) - 1), ids, self.unknown).astype(np.int64)
        begin, counts = self.spoken_first[known], self.spoken_first[known + 1] - self.spoken_first[known]
        data = self.spoken[spread(begin, counts)]
        at = np.concatenate([[0], np.cumsum(counts)])[first]
        lead = np.zeros(len(at) - 1, bool)
        filled = np.flatnonzero(at[1:] > at[:-1])
        lead[filled] = data[at[:-1][filled]] == 0x20
        keep = np.ones(len(data), bool)
        keep[at[:-1][lead]] = False
        offsets = (at - np.concatenate([[0], np.cumsum(lead)])).astype(np.int32)
        data = data[keep]
        out = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
        return out


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _ids_array(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: str, name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text. Null and empty texts have no ids. ``model`` is the path of a SentencePiece BPE
    model with identity normalisation and a space before the text, readable on every executor. Other columns pass through."""
    field = T.StructField(name, T.ArrayType(T.IntegerType()))
    return add_columns(docs, [field], lambda b: [_ids_array(*_pieces(model).encode(b.column("text").to_pylist()))])


def decode(rows: DataFrame, model: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``rows`` with the text of each array of ids; a null array gives an empty text, an unknown id the model's unknown mark."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column("ids_")
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        return [_pieces(model).decode(flat.astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)]))]

    return add_columns(rows.withColumn("ids_", F.col(ids)), [T.StructField(name, T.StringType())], compute, drop=("ids_",), by="ids_")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and decoded, in one pass."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, first = _pieces(model).encode(batch.column("text").to_pylist())
        raw = ids.astype("<u4")
        crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
        return [pa.array(np.diff(first)), pa.array(crc, pa.int64()), _pieces(model).decode(ids, first)]

    fields = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded", T.StringType())]
    return add_columns(docs, fields, compute)
