"""Secrets in texts: an Aho-Corasick prefilter, anchored patterns only at its hits, then checksums where the format has one."""

from __future__ import annotations

import re
import zlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns
from lodestat.llm.words import split

# Kinds in their order, keywords, patterns and least lengths.
KINDS = ["assign", "access", "hex", "github", "npm"]
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "api_key", "apikey"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# End of fixed values.

_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def checksum(body: bytes) -> bytes:
    """CRC-32 of a token's body as six base-62 digits."""
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.encode()


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def _match(kind: str, raw: bytes, at: int, end: int) -> tuple[int, bool] | None:
    """(end, counts as a secret) of the pattern anchored at ``at``."""
    if kind == "assign":
        m = ASSIGN.match(raw, at, end)
        return m and (m.end(), len(m[2]) >= LEAST[kind])
    if kind == "access":
        m = ACCESS.match(raw, at, end)
        return m and (m.end(), m.end() - at >= LEAST[kind])
    m = CHECKED[kind].match(raw, at, end)
    return m and (m.end(), checksum(m[1]) == m[2])


def scan(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start byte, end byte, kind number) of every secret, ordered by text, start and kind."""
    words = split(texts)
    raw = words.data.tobytes()
    found: list[tuple[int, int, int, int]] = []
    over = dict.fromkeys(KINDS, 0)  # end of the last match of each kind
    hits = [(i - n + 1, kind) for i, (kind, n) in _automaton().iter(raw.lower().decode("latin-1"))]
    rows = np.searchsorted(words.offsets, [h[0] for h in hits], "right") - 1 if hits else []
    for (at, kind), row in sorted(zip(hits, rows, strict=True)):
        if at >= over[kind] and (m := _match(kind, raw, at, int(words.offsets[row + 1]))):
            over[kind] = m[0]
            if m[1]:
                found.append((int(row), at, m[0], KINDS.index(kind)))
    mask = _HEX[words.data]
    border = np.zeros(len(mask) + 1, bool)
    border[words.offsets] = True
    before, after = border[:-1].copy(), border[1:].copy()
    before[1:] |= ~mask[:-1]
    after[:-1] |= ~mask[1:]
    starts, ends = np.flatnonzero(mask & before), np.flatnonzero(mask & after) + 1
    long = ends - starts >= LEAST["hex"]
    starts, ends = starts[long], ends[long]
    hexes = np.stack([np.searchsorted(words.offsets, starts, "right") - 1, starts, ends, np.full(len(starts), 2)], axis=1)
    every = np.concatenate([np.array(found, np.int64).reshape(-1, 4), hexes.astype(np.int64)])
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2], every[:, 3]


def _spans(batch: pa.RecordBatch) -> list[pa.Array]:
    texts = batch.column("text")
    row, start, end, kind = scan(texts)
    words = split(texts)
    heads = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=heads[1:])
    base = heads[words.offsets[row]]
    offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    names = pa.array(KINDS).take(pa.array(kind))
    values = pa.StructArray.from_arrays([names, pa.array(heads[start] - base), pa.array(heads[end] - base)], ["kind", "start", "end"])
    return [pa.ListArray.from_arrays(pa.array(offsets), values)]


def find(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """``docs`` with an array of (kind, start, end), in code points, end exclusive, by start and then kind.

    Kinds: assignments to a secret's name, access keys, hexadecimal runs, and GitHub and npm tokens whose embedded CRC-32 holds.
    Matches of one kind do not overlap; those of different kinds may. Null and empty texts have no spans; whole texts are read;
    every row is scanned by itself. Other columns pass through; one named ``name`` is replaced.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return add_columns(docs, [T.StructField(name, T.ArrayType(span))], _spans)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", name: str = "text") -> DataFrame:
    """``docs`` with ``mark`` in place of every secret, in the column ``name``; overlapping secrets become one mark. Null texts stay null."""
    sign = mark.encode()

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text")
        row, start, end, _ = scan(texts)
        if not len(row):
            return [texts]
        out = texts.to_pylist()
        words = split(texts)
        for i in np.unique(row):
            raw, base, parts, at = words.text(i), int(words.offsets[i]), [], 0
            for s, e in zip(start[row == i] - base, end[row == i] - base, strict=True):
                if s >= at:
                    parts += [raw[at:s], sign]
                at = max(at, int(e))
            out[i] = b"".join([*parts, raw[at:]]).decode()
        return [pa.array(out, texts.type)]

    return add_columns(docs, [T.StructField(name, T.StringType())], compute)
