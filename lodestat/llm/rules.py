"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns
from lodestat.llm.textstats import stats
from lodestat.session import checkpointed

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule: (value, up to which it votes good or None if it never does, beyond which it votes bad). Else it abstains.
RULES = {
    "length": (lambda s: -s["n_words"], -50, -20),
    "word_length": (lambda s: _share(s["word_chars"], s["n_words"]), 9, 13),
    "letters": (lambda s: 1 - _share(s["n_letters"], s["word_chars"]), 0.15, 0.35),
    "symbols": (lambda s: _share(s["n_symbols"], s["n_words"]), None, 0.1),
    "same_lines": (lambda s: _share(s["n_dup_lines"], s["n_lines"]), None, 0.6),
    "same_windows": (lambda s: _share(s["n_repeat_words"], s["n_words"]), None, 0.3),
    "capitals": (lambda s: _share(s["n_upper"], s["n_letters"]), None, 0.4),
    "exclamations": (lambda s: _share(s["n_bangs"], s["n_words"]), None, 0.3),
    "echoes": (lambda s: _share(s["n_echo"], s["n_words"]), None, 0.2),
    "known_words": (lambda s: _share(s["n_window_known"], s["n_window_words"]), None, 0.9),
}


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, rules): 1 good, -1 bad, 0 abstains. A text without words gets no good vote."""
    out = np.zeros((len(s["n_words"]), len(RULES)), np.int8)
    for k, (value, good, bad) in enumerate(RULES.values()):
        v = value(s)
        out[v > bad, k] = -1
        if good is not None:
            out[(v <= good) & (s["n_words"] > 0), k] = 1
    return out


@dataclass
class LabelModel:
    """Shares of the classes, and the chance of each rule's votes given the class. Class 0 is good text, class 1 text with a fault that no
    other class knows, the others are the faults that the votes show."""

    share: np.ndarray  # (classes,)
    chance: np.ndarray  # (rules, classes, vote + 1)

    def classes(self, v: np.ndarray) -> np.ndarray:
        """(texts, classes): probability of each class."""
        rules, kinds = np.arange(v.shape[1])[None, :, None], np.arange(len(self.share))[None, None, :]
        logs = np.log(self.chance)[rules, kinds, v[:, :, None] + 1].sum(axis=1) + np.log(self.share)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return self.classes(v)[:, 0]

    @property
    def given_bad(self) -> np.ndarray:
        """(rules, vote + 1): chances of the votes given bad text of any class."""
        return self.chance[:, 1:].transpose(0, 2, 1) @ (self.share[1:] / self.share[1:].sum())


#: Chances of (bad, no, good) votes before any text is seen, for rules that vote both ways and for rules that never vote good: in good
#: text, in text with a fault that the rule knows, and in text whose fault is not known (of these rules about a quarter see it).
TWO_SIDED = {"good": (0.005, 0.095, 0.9), "seen": (0.5, 0.1, 0.4), "unknown": (0.25, 0.15, 0.6)}
ONE_SIDED = {"good": (0.003, 0.996, 0.001), "seen": (0.5, 0.499, 0.001), "unknown": (0.25, 0.749, 0.001)}
#: These chances count as so many texts of each class, whatever the size of the corpus.
PRIOR_TEXTS = 50
#: Faults sought at most, and bounds on the shares of good text and of text with an unknown fault.
FAULTS, LEAST_GOOD, LEAST_UNKNOWN = 8, 0.05, 0.01


def faults(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(faults, rules): sets of rules that find the same fault: their bad votes fall together at least twice as often as by chance.

    Sets grow from the pair that falls together most often beyond chance; a rule joins that does so with every rule of the set. A rule
    whose bad votes come at random falls in no set.
    """
    bad = (patterns == -1).astype(float)
    total = max(counts.sum(), 1.0)
    together = (bad * counts[:, None]).T @ bad
    alone = np.diag(together)
    expected = np.outer(alone, alone) / total
    tied = (together > 2 * expected) & (together >= expected + 3 * np.sqrt(expected) + 5)
    np.fill_diagonal(tied, False)
    excess, out = np.where(tied, together - expected, 0.0), []
    while excess.max(initial=0) > 0 and len(out) < FAULTS:
        a, b = np.unravel_index(np.argmax(excess), excess.shape)
        inside = [int(a), int(b)]
        for r in np.argsort(-together[a], kind="stable"):
            if r not in inside and all(tied[r, x] for x in inside):
                inside.append(int(r))
        out.append(np.isin(np.arange(len(alone)), inside))
        excess[np.ix_(inside, inside)] = 0
    return np.array(out, bool).reshape(len(out), len(alone))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns: good text, each fault that rules agree on, and unknown faults.

    In each class rules vote independently with chances of their own, so a rule's accuracy is judged by the votes that fall together
    with its own. The chances above count as PRIOR_TEXTS texts; only those of the unknown faults stay as they are, as no vote tells them.
    """
    sided = [ONE_SIDED if good is None else TWO_SIDED for _, good, _ in RULES.values()]
    before = [[kind["good"], kind["unknown"]] for kind in sided]
    found = faults(patterns, counts)
    for one in found:
        for row, kind, seen in zip(before, sided, one, strict=True):
            row.append(kind["seen"] if seen else kind["good"])
    before = np.array(before)
    k, total = before.shape[1], counts.sum()
    share = np.r_[0.85, np.full(k - 1, 0.15 / (k - 1))]
    model = LabelModel(share, before)
    last = np.full((len(patterns), k), -1.0)
    for _ in range(rounds if total else 0):
        q = model.classes(patterns)
        if np.abs(q - last).max() < 1e-9:
            break
        last = q
        held = q * counts[:, None]
        chance = np.stack([np.einsum("pc,pr->rc", held, (patterns == v).astype(float)) for v in (-1, 0, 1)], axis=2) + PRIOR_TEXTS * before
        chance /= chance.sum(axis=2, keepdims=True)
        chance[:, 1] = before[:, 1]
        share = (held.sum(axis=0) + 1) / (total + k)
        share = np.maximum(share, np.r_[LEAST_GOOD, LEAST_UNKNOWN, np.zeros(k - 2)])
        model = LabelModel(share / share.sum(), chance)
    return model


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The columns ``carry`` of each row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality
    (posterior probability of good text) and kept.

    kept is false if the base test failed (fewer than 20 words, or over 30 % of the words in repeated 8-word windows), else
    whether the posterior reaches ``threshold``. Null and empty texts have zero words and fail the base test; each row is judged
    by itself, so repeated rows get the same verdict. The votes of all rows are counted by pattern: at most 3^10 rows whatever
    the size of the table, so the model is fitted on every text. A carried column named as a result is replaced by it.
    """
    names = [*BASE, "pattern"]
    carry = tuple(c for c in carry if c.lower() not in {*names, "quality", "base_failed", "kept"})

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        s = stats(batch.column("text"))
        code = (votes(s).astype(np.int64) + 1) @ (3 ** np.arange(len(RULES), dtype=np.int64))
        return [*(pa.array(s[c]) for c in BASE), pa.array(code)]

    fields = [T.StructField(n, T.LongType()) for n in names]
    source = docs.select(*carry, "text")
    counted = checkpointed(add_columns(source, fields, compute, drop=("text",)))
    rows = counted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    codes = np.array([r.pattern for r in rows], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(RULES), dtype=np.int64)) % 3 - 1
    model = fit(patterns, np.array([r.n for r in rows], np.float64))
    quality = model.posterior(patterns) if len(codes) else np.zeros(0)
    known = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, quality, strict=True)], "pattern long, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.join(F.broadcast(known), "pattern")
        .drop("pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
