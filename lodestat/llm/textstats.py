"""Counts over whole texts, computed for all texts of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestat.llm.words import _CODE, Words, mix, range_hashes, split

SYMBOL, UPPER, LETTER, DIGIT, PUNCT, HEAD, BANG, NEWLINE = (1 << k for k in range(8))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&|<>"]] |= SYMBOL
_CLASS[65:91] |= UPPER | LETTER
_CLASS[97:123] |= LETTER
_CLASS[0xC3:0xF5] |= LETTER
_CLASS[48:58] |= DIGIT
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] |= PUNCT
_CLASS[[b for b in range(256) if b & 0xC0 != 0x80]] |= HEAD
_CLASS[[ord(c) for c in "!?"]] |= BANG
_CLASS[10] |= NEWLINE
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in '.!?:;"']] = True
#: Words of a window in which known words are counted, so that the count says the same of long texts as of short ones.
KNOWN_WINDOW = 1999
_ROW_SALT = np.uint64(0x9E3779B97F4A7C15)


def row_sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of values[borders[i]:borders[i + 1]] for every i."""
    padded = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    padded[:-1] = values
    return np.add.reduceat(padded, borders[:-1]) * (np.diff(borders) > 0) if len(borders) > 1 else np.zeros(0, padded.dtype)


def repeats(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the value stands at least twice in its row, it also stands earlier in its row)."""
    key = mix(code + row.astype(np.uint64) * _ROW_SALT)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def known_in_windows(words: Words, row: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words that stand earlier in their window, words), both summed over all windows of ``size`` words of each text; a shorter
    text is one window."""
    key = mix(hashes + row.astype(np.uint64) * _ROW_SALT)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    start = words.first[:-1][row]
    before = start - 1
    before[order[same + 1]] = order[same]
    width = np.minimum(words.counts, size)
    windows = words.counts - width + 1
    at = np.arange(len(hashes)) - start
    # the first of its kind in the windows that begin after the last such word, no more than a window back, and end in the text
    new = np.minimum(at, windows[row] - 1) - np.maximum(np.maximum(before - start, at - width[row]), -1)
    total = width * windows
    return total - row_sums(np.maximum(new, 0), words.first), total


def repeated_words(words: Words, hashes: np.ndarray, k: int) -> np.ndarray:
    """Words per text inside a k-word window that the text holds at least twice."""
    at, code = words.windows(hashes, k)
    twice, _ = repeats(words.row_of(at), code)
    marks = np.zeros(len(hashes) + 1, np.int64)
    marks[at[twice]] += 1
    marks[at[twice] + k] -= 1
    return row_sums(np.cumsum(marks[:-1]) > 0, words.first)


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every \\n-separated line that holds a word."""
    breaks = np.flatnonzero(words.data == 10)
    filled = np.flatnonzero(np.diff(words.offsets) > 0)
    starts = np.sort(np.concatenate([words.offsets[:-1][filled], breaks + 1]))
    ends = np.sort(np.concatenate([words.offsets[1:][filled], breaks]))
    # a break that ends its text opens an empty line whose start is the next text's start; it pairs off with nothing but itself
    held = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(words.offsets, starts, "right") - 1


def stats(texts: pa.Array) -> dict[str, np.ndarray]:
    words = split(texts)
    hashes = words.hashes()
    kinds = _CLASS[words.data]
    n = len(words.offsets) - 1

    def count(bit: int) -> np.ndarray:
        return row_sums((kinds & bit) != 0, words.offsets)

    heads = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum((kinds & HEAD) != 0, out=heads[1:])
    lengths = heads[words.ends] - heads[words.starts]
    starts, ends, row = lines(words)
    codes = range_hashes(_CODE[words.data], starts, ends, 0x9E3779B97F4A7C15) + (ends - starts).astype(np.uint64)
    _, later = repeats(row, codes)
    word_row = np.repeat(np.arange(n), words.counts)
    _, known = repeats(word_row, hashes)
    near, of = known_in_windows(words, word_row, hashes, KNOWN_WINDOW)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    last = words.data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": row_sums(lengths, words.first),
        "n_symbols": count(SYMBOL),
        "n_dup_lines": np.bincount(row[later], minlength=n).astype(np.int64),
        "n_repeat_words": repeated_words(words, hashes, 8),
        "n_lines": np.bincount(row, minlength=n).astype(np.int64),
        "n_closed_lines": np.bincount(row[_STOP[last]], minlength=n).astype(np.int64),
        "n_upper": count(UPPER),
        "n_letters": count(LETTER),
        "n_digits": count(DIGIT),
        "n_punct": count(PUNCT),
        "n_bangs": count(BANG),
        "n_echo": row_sums(echo, words.first),
        "n_known": row_sums(known, words.first),
        "n_window_known": near.astype(np.int64),
        "n_window_words": of.astype(np.int64),
        "n_short": row_sums(lengths <= 3, words.first),
        "n_long": row_sums(lengths >= 16, words.first),
        "n_capital": row_sums((kinds[words.starts] & UPPER) != 0, words.first),
    }
