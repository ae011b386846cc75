"""Fill-in-the-middle samples: unit ends are marked, counted and selected eight bytes at a time."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns
from lodestat.llm.words import bytes_of

# The marks and the shares of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED_PERCENT, SPM_PERCENT = 50, 80
# End of fixed values.

_ONES, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_LOW7 = ~_HIGH
_ONE, _EIGHT, _TOP = np.uint64(1), np.uint64(8), np.uint64(56)


def _at_least(low: np.ndarray, value: int) -> np.ndarray:
    """The high bit of every byte whose lower seven bits reach ``value``; no sum leaves its byte."""
    return (low + _ONES * np.uint64(0x80 - value)) & _HIGH


def _separators(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or 0x09 to 0x0D."""
    low = words & _LOW7
    inside = (_at_least(low, 0x09) & ~_at_least(low, 0x0E)) | (_at_least(low, 0x20) & ~_at_least(low, 0x21))
    return inside & ~words & _HIGH


@dataclass
class Marks:
    """One bit for some bytes of a buffer, with counts of the bits before each 64-bit word."""

    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray) -> Marks:
        before = np.zeros(len(bits) + 1, np.int64)
        np.cumsum(np.bitwise_count(bits), out=before[1:])
        return cls(bits, before)

    def rank(self, position: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before each byte position."""
        word, byte = position >> 3, (position & 7).astype(np.uint64)
        padded = np.append(self.bits, np.uint64(0))
        return self.before[word] + np.bitwise_count(padded[word] & ((_ONE << (byte * _EIGHT)) - _ONE))

    def select(self, number: np.ndarray) -> np.ndarray:
        """The byte position of the marked byte with this number, counted from 0."""
        word = np.searchsorted(self.before, number, "right") - 1
        left = number - self.before[word]
        bits = self.bits[word]
        for _ in range(7):
            bits = np.where(left > 0, bits & (bits - _ONE), bits)
            left = left - 1
        lowest = bits & (~bits + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3)


def unit_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """(bytes that end a unit, bytes that begin a code point) of the texts data[offsets[i]:offsets[i + 1]].

    A unit is a run of separators with the word after it, or the separators at a text's end. So a byte ends a unit if it is no
    separator and the next one is, or if it is a text's last one.
    """
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8").astype(np.uint64, copy=False)
    space = _separators(words)
    after = space >> _EIGHT
    after[:-1] |= space[1:] << _TOP
    ends = ~space & _HIGH & after
    last = offsets[1:][np.diff(offsets) > 0] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * _EIGHT))
    # A byte 10xxxxxx continues a code point; the padding is cut off behind the last byte.
    heads = ~(words & ~(words << _ONE)) & _HIGH
    if len(data) % 8:
        heads[-1] &= (_ONE << np.uint64(len(data) % 8 * 8)) - _ONE
        ends[-1] &= (_ONE << np.uint64(len(data) % 8 * 8)) - _ONE
    return Marks.of(ends), Marks.of(heads)


def _draws(ids: list, seed: int) -> np.ndarray:
    texts = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(texts), ">u4").reshape(-1, 4).astype(np.int64)


def restore(output: str | bytes, form: str) -> str | bytes:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    p, s, m = (x if isinstance(output, str) else x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    head, middle = output.split(m)
    if form == "psm":
        prefix, suffix = head[len(p) :].split(s)
    else:
        suffix, prefix = head[len(s) :].split(p)
    return prefix + middle + suffix


def transform(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars, output and restored; columns of these names are replaced.

    A text of n units is cut at two of its n + 1 unit borders, drawn from the SHA-256 of seed and doc_id, and rearranged as prefix,
    suffix, middle (psm) or suffix, prefix, middle (spm), or left as it is (plain; counts null). Texts that hold a mark stay plain, so
    every output can be turned back. A null or empty text has no units and is plain with an empty output. A null doc_id draws like an
    empty one; rows of one doc_id draw alike; every row is handled by itself, whole, whatever its length.
    """
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType(), "restored": T.StringType()}
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = bytes_of(batch.column("text"))
        ends, heads = unit_marks(data, offsets)
        begin = ends.rank(offsets)
        n = np.diff(begin)
        draws = _draws(batch.column("doc_id").to_pylist(), seed)
        cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
        at = np.empty((len(n), 2), np.int64)
        for side in (0, 1):
            whole = cuts[:, side] > 0
            at[:, side] = offsets[:-1]
            at[whole, side] = ends.select(begin[:-1][whole] + cuts[whole, side] - 1) + 1
        chars = heads.rank(np.stack([offsets[:-1], at[:, 0], at[:, 1]], axis=1).ravel()).reshape(-1, 3)
        raw = data.tobytes()
        forms, outputs, back = [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = raw[a:b]
            if not text or draws[i, 2] % 100 >= CHANGED_PERCENT or any(x in text for x in marks):
                form, output = "plain", text
            else:
                x, y = at[i].tolist()
                prefix, middle, suffix = marks[0] + raw[a:x], marks[2] + raw[x:y], marks[1] + raw[y:b]
                form = "spm" if draws[i, 3] % 100 < SPM_PERCENT else "psm"
                output = suffix + prefix + middle if form == "spm" else prefix + suffix + middle
            forms.append(form)
            outputs.append(output)
            back.append(restore(output, form))
        plain = np.array([f == "plain" for f in forms], bool)
        return [
            pa.array(n, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain),
            pa.array(chars[:, 2] - chars[:, 1], pa.int64(), mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string()),
            pa.array(back, pa.binary()).cast(pa.string()),
        ]

    return add_columns(docs, [T.StructField(k, v) for k, v in kinds.items()], compute)


def digests(docs: DataFrame) -> DataFrame:
    """Hashes in place of the two texts of ``transform``."""
    hashed = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
