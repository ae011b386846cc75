"""Removal of word windows that already stand earlier in the corpus (Rabin-Karp hashes of every window, counted in Spark)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import unused
from lodestat.llm.exchange import add_columns, bucket_by_bucket, bucket_count, text_bytes
from lodestat.llm.words import SLICE_BYTES, Words, chunks, longs, packed, split

#: Text whose windows make up one bucket, windows that a task collects before it sends them on.
BUCKET_BYTES, FLUSH_WINDOWS = 12 << 20, 1_000_000


def _gaps(doc: np.ndarray, pos: np.ndarray) -> tuple[int, bytes]:
    """Positions, ascending within each document, as gaps of one byte with 255 for "255 more"; four bytes each if that is less."""
    gap = pos.astype(np.int64)
    same = doc[1:] == doc[:-1]
    gap[1:][same] -= pos[:-1][same]
    full = gap // 255
    if full.sum() >= 3 * len(gap):
        return 0, pos.astype(np.uint32).tobytes()
    out = np.full(len(gap) + int(full.sum()), 255, np.uint8)
    out[np.arange(len(gap)) + np.cumsum(full)] = gap % 255
    return len(out), out.tobytes()


def _positions(doc: np.ndarray, size: int, raw: memoryview) -> np.ndarray:
    if not size:
        return np.frombuffer(raw, np.uint32, len(doc)).astype(np.int32)
    codes = np.frombuffer(raw, np.uint8, size)
    sums = np.cumsum(codes, dtype=np.int64)[codes < 255]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    base = np.where(first > 0, sums[first - 1], 0)
    return (sums - np.repeat(base, np.diff(np.r_[first, len(doc)]))).astype(np.int32)


def _pack(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None) -> bytes:
    """Entries of one bucket, in order of (doc, pos): the documents once, then counts, gaps and hashes."""
    used, counts = np.unique(doc, return_counts=True)
    size, gaps = _gaps(doc, pos)
    head = np.array([len(used), len(doc), size, hashes is not None], np.int64)
    parts = [head, ids[used], keys[used], counts.astype(np.uint32)]
    return b"".join([*(p.tobytes() for p in parts), b"" if hashes is None else hashes.tobytes(), gaps])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    docs, n, size, hashed = (int(x) for x in np.frombuffer(raw, np.int64, 4))
    at = 32
    ids, keys = np.frombuffer(raw, np.int64, docs, at), np.frombuffer(raw, np.int64, docs, at + 8 * docs)
    at += 16 * docs
    doc = np.repeat(np.arange(docs, dtype=np.int32), np.frombuffer(raw, np.uint32, docs, at))
    at += 4 * docs
    hashes = np.frombuffer(raw, np.uint64, n, at) if hashed else None
    return ids, keys, doc, _positions(doc, size, memoryview(raw)[at + 8 * n * hashed :]), hashes


def _later(hashes: np.ndarray, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: entries whose hash also stands at a smaller (id, pos); entries that are the only one sent on for their hash."""
    order = np.argsort(hashes)
    same = np.zeros(len(order) + 1, bool)
    ranked = hashes[order]
    same[1:-1] = ranked[1:] == ranked[:-1]
    shared = order[same[1:] | same[:-1]]
    del order, ranked
    later = np.zeros(len(hashes), bool)
    if len(shared):
        shared = shared[np.lexsort((pos[shared], ids[doc[shared]], hashes[shared]))]
        h, i, p = hashes[shared], ids[doc[shared]], pos[shared]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.r_[start, len(shared)])
        later[shared] = (i != np.repeat(i[start], runs)) | (p != np.repeat(p[start], runs))
    return later, ~later


def _by_bucket(kind: int, buckets: np.ndarray, ids, keys, doc, pos, hashes) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(buckets, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0]) if len(order) else []
    for part in np.split(order, cut[1:]) if len(order) else ():
        yield kind, int(buckets[part[0]]), _pack(ids, keys, doc[part], pos[part], None if hashes is None else hashes[part])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], ["kind", "bucket", "payload"])


def _doc_buckets(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ keys.astype(np.uint64)
    return (((spread >> np.uint64(20)) % np.uint64(n)).astype(np.int32))[doc]


def _hash_windows(window: int, n: int):
    """Windows of each task by bucket (kind 0), and repeats that the task saw itself (kind 1)."""

    def flush(parts: list[tuple]) -> pa.RecordBatch | None:
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]
        ids, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc = np.concatenate([p[2] + s for p, s in zip(parts, shift.astype(np.int32), strict=True)])
        pos, hashes, bucket = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        parts.clear()
        later, on = _later(hashes, ids, doc, pos)
        rows = [*_by_bucket(0, bucket[on], ids, keys, doc[on], pos[on], hashes[on])]
        rows += _by_bucket(1, _doc_buckets(ids, keys, doc[later], n), ids, keys, doc[later], pos[later], None)
        return _rows(rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in chunks(batches, limit=SLICE_BYTES):
            batch = batch.filter(batch.column("doc_id").is_valid())
            words = split(batch.column("text"))
            hashes = words.hashes()
            at, code = words.windows(hashes, window)
            doc = words.row_of(at)
            bucket = (words.windows(hashes, window, 1)[1] % np.uint64(n)).astype(np.int32)
            own = longs(batch.column("doc_id")), longs(batch.column("key")), doc.astype(np.int32), (at - words.first[doc]).astype(np.int32)
            parts.append((*own, code, bucket))
            held += len(at)
            if held >= FLUSH_WINDOWS:
                out = flush(parts)
                parts, held = [], 0
                if out is not None:
                    yield out
        if held and (out := flush(parts)) is not None:
            yield out

    return run


def _gather(payloads: list[pa.Buffer]) -> tuple[np.ndarray, ...]:
    """All entries of some payloads, their documents numbered through; the list is emptied on the way."""
    parts, docs = [], 0
    payloads.reverse()
    while payloads:
        ids, keys, doc, pos, hashes = _unpack(payloads.pop())
        parts.append((ids, keys, doc + np.int32(docs), pos, hashes))
        docs += len(ids)
    ids, keys, doc, pos = (np.concatenate([p[k] for p in parts]) for k in range(4))
    return ids, keys, doc, pos, None if parts[0][4] is None else np.concatenate([p[4] for p in parts])


def _find_repeats(n: int) -> Callable[[list[pa.Buffer]], Iterator[pa.RecordBatch]]:
    """Of one bucket's windows, those that also start earlier, by their documents' bucket."""

    def handle(payloads: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        ids, keys, doc, pos, hashes = _gather(payloads)
        later, _ = _later(hashes, ids, doc, pos)
        del hashes
        doc, pos = doc[later], pos[later]
        rows = [*_by_bucket(1, _doc_buckets(ids, keys, doc, n), ids, keys, doc, pos, None)]
        if rows:
            yield _rows(rows)

    return handle


def _merge(window: int) -> Callable[[list[pa.Buffer]], Iterator[pa.RecordBatch]]:
    """Repeated windows of each document as maximal intervals of words."""

    def handle(payloads: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        ids, keys, doc, pos, _ = _gather(payloads)
        order = np.lexsort((pos, keys[doc], ids[doc]))
        i, k, p = ids[doc][order], keys[doc][order], pos[order]
        border = np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])]
        cut = np.flatnonzero(border | np.r_[True, p[1:] > p[:-1] + window])
        start, end = p[cut], np.r_[p[cut[1:] - 1], p[-1:]] + window
        first = np.flatnonzero(border[cut])
        offsets = np.r_[first, len(cut)].astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(offsets), spans)
        yield pa.RecordBatch.from_arrays([pa.array(i[cut[first]]), pa.array(k[cut[first]]), lists], ["doc_id", "key", "spans"])

    return handle


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, key, spans): the maximal word intervals to remove from each document that has any; key is xxhash64(text).

    Each task sends on one entry per distinct window, so a passage that stands in a third of all rows reaches its bucket once per
    task and not once per row. A bucket holds the windows of about BUCKET_BYTES of text: the number of buckets follows the input.
    Every bucket is a partition of its own.
    Windows are equal if 64 hash bits and the bucket of a second, independent hash agree.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    n = bucket_count(text_bytes(docs), BUCKET_BYTES)
    kind = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("payload", T.BinaryType())])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    sent = rows.mapInArrow(_hash_windows(window, n), kind)
    found = sent.repartitionById(n, F.col("bucket").cast("int")).mapInArrow(bucket_by_bucket(_find_repeats(n), through=1), kind)
    return found.repartitionById(n, F.col("bucket").cast("int")).mapInArrow(bucket_by_bucket(_merge(window)), out)


def _cut(batch: pa.RecordBatch, found: str) -> list[pa.Array]:
    words = split(batch.column("text"))
    spans = batch.column(found)
    flat = spans.flatten()
    sizes = longs(pa.compute.list_value_length(spans))
    row = np.repeat(np.arange(len(sizes)), sizes)
    marks = np.zeros(len(words.starts) + 1, np.int32)
    if len(row):
        np.add.at(marks, words.first[row] + longs(flat.field("start")), 1)
        np.add.at(marks, words.first[row] + longs(flat.field("end")), -1)
    keep = np.cumsum(marks)[:-1] <= 0
    text, _ = joined(words, keep)
    removed = np.add.reduceat(np.r_[~keep, False], words.first[:-1]) * (words.counts > 0) if len(keep) else np.zeros(len(sizes), np.int64)
    return [pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), text]


def joined(words: Words, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The kept words of each text, joined by one space."""
    mask = np.zeros(len(words.data), bool)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    word_byte = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    mask[word_byte] = np.repeat(keep, words.ends - words.starts)
    kept = np.flatnonzero(keep)
    row = words.row_of(kept)
    follows = np.zeros(len(kept), bool)
    follows[:-1] = row[1:] == row[:-1]
    data = words.data.copy()
    gap = words.ends[kept[follows]]
    data[gap] = 0x20
    mask[gap] = True
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    offsets = sums[words.offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes())]), offsets


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: every word covered by a window that also starts earlier is cut.

    Earlier means a smaller doc_id, or an earlier word of the same document; windows are judged on the input. The words kept are
    joined by one space. Rows without doc_id keep all words and are compared with nothing; a null text counts as empty; texts
    with fewer words than the window lose nothing. Rows that share a doc_id and text get the same result; rows that share only
    the doc_id are compared as one document. Other columns pass through; columns named as the new ones are replaced.
    """
    row, found = unused("row", docs), unused("spans", docs)
    spans = repeated_spans(docs, window).select(F.struct("doc_id", "key").alias(row), F.col("spans").alias(found))
    key = F.struct(docs.doc_id.cast("long").alias("doc_id"), F.xxhash64(docs.text).alias("key"))
    joined_ = docs.join(spans, (docs.doc_id.isNotNull()) & (key == spans[row]), "left").drop(row)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return add_columns(joined_, fields, lambda batch: _cut(batch, found), drop=(found,))
