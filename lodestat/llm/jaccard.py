"""N-gram Jaccard self-join of documents by a token-group matrix, and its connected components.

* A document is the set of its k-word shingles. The range of shingle hashes is cut into segments; what a set holds of one segment
  is a token. Two sets whose Jaccard similarity reaches the threshold differ in at most D elements, so with more than D segments
  in use they agree on at least one whole, non-empty token. (A set with too few segments in use gets its prefix-filter elements
  as further tokens.) Segment numbers depend on the size class, and a set takes part in each class in which a partner can be.
* Groups: each task joins documents that it finds similar to one group and sends the union of the group's tokens, once.
* Two groups that share no token cannot hold a link. Of those that share one, first the first documents are compared; only groups
  that this leaves in different components are opened. Their members meet token by token in blocks of bounded size, where counts
  of shingles by hash range bound every overlap from above; only pairs within the bound leave the block. Every link is verified on
  the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import bucket_by_bucket, bucket_count, components, settled, text_bytes
from lodestat.llm.words import SLICE_BYTES, chunks, longs, mix, packed, range_hashes, split
from lodestat.session import checkpointed

FLUSH_WORDS = 500_000
BLOCK_ROWS = 4096
BLOCK_SHINGLES = 2 << 20  # 16 MB of sets
BUCKET_BYTES = 16 << 20  # text whose tokens make up one bucket, which is a partition of its own
_SHORT = 5  # bytes of a token that are sent; its bucket tells further bits, and a false match only costs a comparison
_GROWTH = 1.5
_MEMBER, _TOKENS, _SHARED = 0, 1, 2


@cache
def _classes(part: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest size, D, segments) of every size class for the threshold part / whole."""
    upper, d, segments, size = [], [], [], 0
    while size < 1 << 40:
        low, size = size + 1, max(size + 1, int(size * _GROWTH))
        most = size * (whole - part) // part
        n = most + 1
        for _ in range(3 if most else 0):  # room for segments that stay empty
            empty = n * math.exp(-low / n)
            n = most + 1 + math.ceil(empty + 3 * math.sqrt(empty))
        upper.append(size)
        d.append(most)
        segments.append(n)
    return np.array(upper), np.array(d), np.array(segments)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, by text and hash, and their number per text."""
    words = split(texts)
    hashes = words.hashes(lower=True)
    at, code = words.windows(hashes, k)
    row = words.row_of(at)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    whole = mix(range_hashes(hashes, words.first[short], words.first[short + 1], 0xE7037ED1A0B428DB) + words.counts[short].astype(np.uint64))
    row, code = np.concatenate([row, short]), np.concatenate([code, whole])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code = row[new], code[new]
    return row, code, np.bincount(row, minlength=len(texts))


def _sum_by(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, cut) if len(cut) else values[:0]


def tokens(row: np.ndarray, code: np.ndarray, sizes: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of sets given by text and hash; see the module's head."""
    upper, most, segments = _classes(part, whole)
    own = np.searchsorted(upper, sizes)
    lowest = np.searchsorted(upper, -(-sizes * part // whole))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out_row, out_token = [], []
    for back in range(int((own - lowest)[sizes > 0].max(initial=0)) + 1):
        level = own - back
        use = (level >= lowest) & (sizes > 0)
        inside = use[row]
        r, c = row[inside], code[inside]
        segment = ((c >> np.uint64(32)) * segments[level[r]].astype(np.uint64)) >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (segment[1:] != segment[:-1])])) if len(r) else np.zeros(0, np.int64)
        head = r[cut]
        salt = level[head].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + segment[cut]
        out_row.append(head)
        out_token.append(mix(_sum_by(mix(c, 0x5851F42D4C957F2D), cut) + mix(salt)))
        used = np.bincount(head, minlength=len(sizes))
        few = np.flatnonzero(use & (used <= most[np.maximum(level, 0)]))
        prefix = sizes[few] - -(-sizes[few] * part // whole) + 1
        at = np.repeat(first[few] - np.concatenate([[0], np.cumsum(prefix)[:-1]]), prefix) + np.arange(prefix.sum())
        out_row.append(np.repeat(few, prefix))
        out_token.append(mix(code[at] + level[np.repeat(few, prefix)].astype(np.uint64), 0x14057B7EF767814F))
    return np.concatenate(out_row), np.concatenate(out_token)


def sketches(row: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each set the number of its hashes in each of 2^b equal ranges, one byte each; b grows with the set. A set with more
    than 255 hashes in a range has no sketch."""
    bits = np.clip(np.log2(np.maximum(sizes, 1)).astype(np.int64), 6, 24)
    width = np.where(sizes > 0, 1 << bits, 0)
    first = np.cumsum(width) - width
    counts = np.bincount(first[row] + (mix(code, 0x2127599BF4325C37) >> (64 - bits[row]).astype(np.uint64)).astype(np.int64), minlength=int(width.sum()))
    full = np.unique(np.searchsorted(first, np.flatnonzero(counts > 255), "right") - 1)
    if len(full):
        keep = np.ones(len(sizes), bool)
        keep[full] = False
        counts, width = counts[np.repeat(keep, width)], np.where(keep, width, 0)
    return packed(width, counts.astype(np.uint8).tobytes())


def _linked(overlap, a, b, part: int, whole: int):
    return whole * overlap >= part * (a + b - overlap)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest number reachable over the pairs, for 0 .. n - 1."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _local_groups(row, code, sizes, fp, ids, part, whole) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each text, text and token of what is sent): equal sets and texts similar to a token's first text become one group.

    A group's number is that of its text with the smallest doc_id.
    """
    order = np.lexsort((ids, fp[:, 1], fp[:, 0], sizes))
    same = np.concatenate([[False], (sizes[order][1:] > 0) & (sizes[order][1:] == sizes[order][:-1]) & (fp[order][1:] == fp[order][:-1]).all(axis=1)])
    twin = np.empty(len(sizes), np.int64)  # the text of an equal set with the smallest doc_id
    twin[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    alone = twin[row] == row
    at, token = tokens(row[alone], code[alone], np.where(twin == np.arange(len(sizes)), sizes, 0), part, whole)
    order = np.lexsort((ids[at], token))
    t, a = token[order], at[order]
    new = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
    lead = a[np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))] if len(t) else a
    pairs = np.unique(np.stack([a[lead != a], lead[lead != a]], axis=1), axis=0)
    small, large = np.minimum(sizes[pairs[:, 0]], sizes[pairs[:, 1]]), np.maximum(sizes[pairs[:, 0]], sizes[pairs[:, 1]])
    pairs = pairs[whole * small >= part * large]
    first = np.concatenate([[0], np.cumsum(sizes)])
    held = [
        _linked(len(np.intersect1d(code[first[x] : first[x + 1]], code[first[p] : first[p + 1]], assume_unique=True)), sizes[x], sizes[p], part, whole)
        for x, p in pairs
    ]
    pairs = pairs[np.array(held, bool)] if len(pairs) else pairs
    rank = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[rank] = np.arange(len(ids))
    group = rank[_roots(len(ids), place[np.concatenate([pairs, np.stack([np.arange(len(ids)), twin], axis=1)])])[place]]
    sent = np.unique(np.stack([group[at].astype(np.uint64), token], axis=1), axis=0)
    return group, sent[:, 0].astype(np.int64), sent[:, 1]


_ROW = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("doc_id", "n", "group", "fp1", "fp2")]
    + [T.StructField("payload", T.BinaryType())]
)
_NAMES = [f.name for f in _ROW.fields]


def _batch(kind: int, height: int, **columns) -> pa.RecordBatch:
    types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
    given = [pa.array(np.full(height, kind, np.int32)) if name == "kind" else columns.get(name) for name in _NAMES]
    arrays = [pa.nulls(height, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(given, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _group(k: int, part: int, whole: int, buckets: int):
    """A row for every document with its group; the groups' tokens by bucket."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        ids, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + s for p, s in zip(parts, shift[:-1], strict=True)])
        code, sizes = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        parts.clear()
        cut = np.concatenate([[0], np.cumsum(sizes)])[:-1][sizes > 0]
        fp = np.zeros((len(sizes), 2), np.uint64)
        fp[sizes > 0] = np.stack([_sum_by(mix(code, s), cut) for s in (0x632BE59BD9B4E019, 0x9FB21C651E98DF25)], axis=1)
        group, at, token = _local_groups(row, code, sizes, fp, ids, part, whole)
        spread = pa.array((ids.astype(np.uint64) % np.uint64(buckets)).astype(np.int64))
        yield _batch(_MEMBER, len(ids), bucket=spread, doc_id=ids, n=sizes, group=ids[group], fp1=fp[:, 0].view(np.int64), fp2=fp[:, 1].view(np.int64), payload=sketches(row, code, sizes))
        bucket = (token >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((at, bucket))
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            used, counts = np.unique(at[own], return_counts=True)
            payload = b"".join(p.tobytes() for p in (np.int64([len(used)]), ids[used], counts.astype(np.uint32), token[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SHORT]))
            yield _batch(_TOKENS, 1, bucket=[int(bucket[own[0]])], payload=[payload])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in chunks(batches, limit=SLICE_BYTES):
            batch = batch.filter(batch.column("doc_id").is_valid())
            row, code, sizes = shingles(batch.column("text"), k)
            parts.append((longs(batch.column("doc_id")), row, code, sizes))
            held += len(code)
            if held >= FLUSH_WORDS:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _read(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    ids, counts = np.frombuffer(payload, np.int64, n, 8), np.frombuffer(payload, np.uint32, n, 8 + 8 * n)
    wide = np.zeros((int(counts.sum()), 8), np.uint8)
    wide[:, :_SHORT] = np.frombuffer(payload, np.uint8, -1, 8 + 12 * n).reshape(-1, _SHORT)
    return np.repeat(ids, counts), wide.view("<u8").ravel()


def _share(payloads: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
    """Of one bucket, the tokens that several groups hold: a row (list, group) for each; tokens held by the same groups give one list."""
    parts = []
    while payloads:
        parts.append(_read(payloads.pop()))
    group, token = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    order = np.argsort(token)
    ranked = token[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
    held = same[1:] | same[:-1]
    order, ranked = order[held], ranked[held]
    order = order[np.lexsort((group[order], ranked))]
    g, t = group[order], token[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])]) if len(t) else np.zeros(0, bool)
    g, t = g[new], t[new]
    cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([cut, [len(t)]]))
    name = _sum_by(mix(g.astype(np.uint64)), cut)
    _, keep = np.unique(name, return_index=True)
    take = np.zeros(len(cut), bool)
    take[keep] = True
    take &= counts > 1
    rows = np.repeat(take, counts)
    if rows.any():
        yield _batch(_SHARED, int(rows.sum()), fp1=np.repeat(name, counts)[rows].view(np.int64), group=g[rows])


def _bounded_pairs(part: int, whole: int):
    """Pairs (a, b) of one block, in different components, whose sizes and range counts allow a link.

    Rows come ordered by block; those of one block are compared at once, however they fall into batches.
    """

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n, root, side = (table.column(c).to_numpy() for c in ("doc_id", "n", "root", "side"))
        raw = table.column("payload").to_pylist()
        least = min((len(b) for b in raw if b), default=1)
        counts = np.full((len(ids), least), 2**32 - 1, np.uint32)  # without a sketch: no bound
        for k, b in enumerate(raw):
            if b:
                counts[k] = np.frombuffer(b, np.uint8).reshape(least, -1).sum(axis=1)
        two_sided = side.min() != side.max()
        step = max(1, (8 << 20) // (least * len(ids)))
        for at in range(0, len(ids), step):
            mine = slice(at, at + step)
            may = (root[mine, None] != root[None]) & (ids[mine, None] < ids[None] if not two_sided else (side[mine, None] == 0) & (side[None] == 1))
            small, large = np.minimum(n[mine, None], n[None]), np.maximum(n[mine, None], n[None])
            i, j = np.nonzero(may & (whole * small >= part * large))
            for cut in range(0, len(i), max(1, (8 << 20) // least)):
                a, b = i[cut : cut + max(1, (8 << 20) // least)] + at, j[cut : cut + max(1, (8 << 20) // least)]
                most = np.minimum(np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64), np.minimum(n[a], n[b]))
                held = _linked(most, n[a], n[b], part, whole)
                a, b = ids[a[held]], ids[b[held]]
                unit = [pa.array(np.full(len(a), table.column(c)[0].as_py()), t) for c, t in (("list", pa.int64()), ("low", pa.int32()), ("high", pa.int32()))]
                if len(a):
                    yield pa.RecordBatch.from_arrays([*unit, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["list", "low", "high", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "low", "high")])
            cut = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                own = tuple(keys[:, a])
                if own != name and held:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                name = own
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def _named_in(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents that the pairs name, and a few others.

    A bitmap of hashed ids (16 bits for each id, 32 MB at most) goes to all tasks, so that texts which no pair needs are not
    shuffled. Where it fills up, more texts are, with the same result.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    bits = 1 << min(28, max(16, (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(slot / 64).alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = longs(batch.column("slot"))
            held = (shared.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(held.astype(bool))).select(["id_", "text"])

    tagged = docs.where("doc_id is not null").select(F.col("doc_id").alias("id_"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("slot"))
    return tagged.mapInArrow(run, "id_ long, text string")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) whose texts link."""
    pairs = checkpointed(pairs)
    texts = _named_in(pairs, docs)
    both = pairs.join(texts, pairs.a == texts.id_).select("a", "b", F.col("text").alias("text_a"))
    both = both.join(texts, both.b == texts.id_).select("a", "b", "text_a", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outer in chunks(batches, "text_a"):
            for batch in chunks(iter([outer]), "text_b"):
                row, code, sizes = shingles(batch.column("text_a"), k)
                other_row, other, other_sizes = shingles(batch.column("text_b"), k)
                salted = [mix(c + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for r, c in ((row, code), (other_row, other))]
                overlap = np.bincount(row[np.isin(*salted)], minlength=len(sizes))
                held = _linked(overlap, sizes, other_sizes, part, whole) & (sizes > 0)
                yield batch.select(["a", "b"]).filter(pa.array(held))

    return both.mapInArrow(run, "a long, b long")


def _links_in(k: int, part: int, whole: int):
    """Links among the pairs of each unit. A unit's texts come first, of which only the sets are held, and then its pairs, compared
    as they come; pairs joined by links found so far are left out, as they cannot change the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = None
        sets: dict[int, list[np.ndarray]] = {}
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def hold(texts: pa.RecordBatch) -> None:
            for batch in chunks(iter([texts])):
                _, code, sizes = shingles(batch.column("text"), k)
                for i, own in zip(batch.column("a").to_pylist(), np.split(code, np.cumsum(sizes)[:-1]), strict=True):
                    root.setdefault(i, i)
                    held = sets.setdefault(i, [])  # several if rows share a doc_id
                    if not any(np.array_equal(own, x) for x in held):
                        held.append(own.copy())

        def links(pairs: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
                if find(a) != find(b) and any(
                    len(x) and len(y) and _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), part, whole) for x in sets[a] for y in sets[b]
                ):
                    root[find(a)] = find(b)
                    out.append((a, b))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "low", "high")])
            paired = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (paired[1:] != paired[:-1])]))
            for at, end in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if tuple(keys[:, at]) != name:
                    name = tuple(keys[:, at])
                    sets.clear()
                    root.clear()
                own = batch.slice(int(at), int(end - at))
                if paired[at]:
                    yield links(own)
                else:
                    hold(own)

    return run


def _verify_units(pairs: DataFrame, docs: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """The links among pairs (list, low, high, a, b), each compared in its unit, to which every text is sent once."""
    unit = ["list", "low", "high"]
    texts = _named_in(pairs, docs)
    sides = pairs.select(*unit, F.col("a").alias("id")).union(pairs.select(*unit, "b")).distinct()
    given = sides.join(texts, sides.id == texts.id_).select(*unit, F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    rows = given.union(pairs.select(*unit, "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, F.col("b").isNotNull(), "a", "b")
    return rows.mapInArrow(_links_in(k, part, whole), "a long, b long")


def link(docs: DataFrame, k: int = 3, part: int = 90, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when whole * |A and B| >= part * |A or B|.

    Words are lower-cased in A-Z. component_id is the smallest doc_id reachable over links, itself included. Null, empty and blank
    texts have no shingles and link with nothing; texts of fewer than k words are one shingle. Rows without doc_id keep a null
    component; rows that share a doc_id are one node. No rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = bucket_count(text_bytes(rows), BUCKET_BYTES)
    sent = rows.mapInArrow(_group(k, part, whole, n), _ROW).repartitionById(n, F.col("bucket").cast("int"))
    found = settled(sent.mapInArrow(bucket_by_bucket(_share, through=_MEMBER), _ROW))
    members = found.where(F.col("kind") == _MEMBER).select("doc_id", "n", "group", "fp1", "fp2", "payload")
    shared = checkpointed(found.where(F.col("kind") == _SHARED).select(F.col("fp1").alias("list"), "group").distinct())

    heads = members.where("doc_id = group and n > 0").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("n", "fp1", "fp2")))
    # Equal sets, whatever their tasks, are tied to the one with the smallest doc_id; only this one is opened later.
    sets = members.where("n > 0").select("n", "fp1", "fp2", "doc_id", "group")
    firsts_of = checkpointed(sets.groupBy("n", "fp1", "fp2").agg(F.min(F.struct("doc_id", "group")).alias("first")).select("n", "fp1", "fp2", "first.*"))
    tied = firsts_of.select("n", "fp1", "fp2", F.col("group").alias("b"))
    equal = sets.select("n", "fp1", "fp2", F.col("group").alias("a")).distinct().join(tied, ["n", "fp1", "fp2"]).where("a <> b").select("a", "b").distinct()

    def fit(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs whose sizes allow a link and whose sets are not known to be equal."""
        x = nodes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("fp1").alias("fp_a"))
        y = nodes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("fp1").alias("fp_b"))
        sized = pairs.join(x, "a").join(y, "b")
        close = whole * F.least("n_a", "n_b") >= part * F.greatest("n_a", "n_b")
        return sized.where(close & ((F.col("n_a") != F.col("n_b")) | (F.col("fp_a") != F.col("fp_b")))).select("a", "b")

    firsts = shared.groupBy("list").agg(F.min("group").alias("b"))
    star = shared.join(firsts, "list").where(F.col("group") != F.col("b")).select(F.col("group").alias("a"), "b").distinct()
    edges = settled(equal.union(_verify(fit(star, heads), rows, k, part, whole)))
    roots = components(edges)

    rooted = shared.join(roots, shared.group == roots.node, "left").select("list", "group", F.coalesce("root", "group").alias("root"))
    divided = rooted.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("list")
    inside = firsts_of.select("doc_id", "group")
    lists = checkpointed(rooted.join(divided, "list").join(inside, "group").select("list", "root", "doc_id").distinct())
    weight = sets.select("n", "fp1", "fp2", "doc_id").distinct().join(lists.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weight = checkpointed(weight)
    # Documents tied by lists get a common label: twice the smallest of their lists, each time followed once. Lists whose documents
    # all carry one label are compared together, so each document is sent once; any other list, and any label with more documents
    # or shingles than a block, is compared list by list.
    label = lists.select("doc_id", F.col("doc_id").alias("label")).distinct()
    for _ in range(2):
        least = lists.join(label, "doc_id").groupBy("list").agg(F.min("label").alias("label"))
        lower = lists.join(least, "list").groupBy("doc_id").agg(F.min("label").alias("label"))
        lead = lower.select(F.col("doc_id").alias("lead"), F.col("label").alias("its"))
        label = checkpointed(lower.join(lead, F.col("label") == F.col("lead")).select("doc_id", F.col("its").alias("label")))
    labelled = lists.join(label, "doc_id")
    whole_lists = labelled.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high").select("list", F.col("low").alias("label"))
    within = label.join(weight, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    within = within.where((F.col("size") <= BLOCK_ROWS) & (F.col("weight") <= BLOCK_SHINGLES)).select("label")
    covered = checkpointed(whole_lists.join(within, "label"))
    alone = labelled.join(covered.select("label").distinct(), "label", "left_semi").select(F.col("label").alias("list"), "doc_id", "root").distinct()
    many = lists.join(covered.select("list"), "list", "left_anti").select("list", "doc_id", "root")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("weight") / BLOCK_SHINGLES)).cast("int")
    blocks = many.join(weight, "doc_id").groupBy("list").agg(blocks.alias("blocks"))
    units = settled(alone.withColumn("blocks", F.lit(1)).union(many.join(blocks, "list").select("list", "doc_id", "root", "blocks")))
    known = members.where("n > 0").join(firsts_of.join(units, "doc_id", "left_semi"), ["doc_id", "n", "fp1", "fp2"], "left_semi")
    known = known.groupBy("doc_id", "fp1", "fp2").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))
    met = units.join(known, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    met = met.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    opened = met.select("list", "low", "high", "side", "root", "doc_id", "n", "payload").mapInArrow(
        _bounded_pairs(part, whole), "list long, low int, high int, a long, b long"
    )
    opened = settled(opened.groupBy("a", "b").agg(F.min(F.struct("list", "low", "high")).alias("unit")).select("unit.*", "a", "b"))
    del met, known
    grouped = members.where("doc_id <> group").select(F.col("doc_id").alias("a"), F.col("group").alias("b"))
    late = _verify_units(opened, rows, k, part, whole)
    late = late.join(grouped, "a", "left").select(F.coalesce(grouped.b, "a").alias("a"), late.b.alias("y"))
    late = late.join(grouped.select(F.col("a").alias("y"), F.col("b").alias("g")), "y", "left").select("a", F.coalesce("g", "y").alias("b"))
    late = settled(late)
    final = components(edges.union(late)) if late.limit(1).count() else roots

    out = members.join(final, members.group == final.node, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "group").alias("component_id"))
    return out.union(_without_id(rows, k))


def _without_id(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=SLICE_BYTES):
            n = shingles(batch.column("text"), k)[2]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return rows.where("doc_id is null").mapInArrow(run, "doc_id long, n_shingles long, component_id long")
