"""Quality rules: a decision list learned from labelled text statistics.

``text_stats`` measures whole texts.  ``learn_list`` grows conjunctions of thresholds
by information gain on two thirds of the labelled rows, prunes each on the last third,
removes what it covers and goes on (sequential covering).  ``DecisionList.column``
emits the rules as one ordered Spark conditional expression.

Null and empty texts have no words; repeated rows are judged alike; a null id is
carried along; with no labels of both kinds the list is empty and rejects nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, parts_of

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Labelled rows the list is learned from, at most.
SAMPLE_ROWS = 6000


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs twice or more, first included."""
    n = len(words)
    if n < 4:
        return 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    kinds = len(number)
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mask = np.zeros(n, bool)
    for shift in range(3):
        mask[shift : n - 2 + shift] |= twice
    return int(mask.sum())


def measure(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """The statistics of one whole text."""
    raw = raw or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(raw.translate(None, _SPACE).decode("utf-8", "replace")),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and the statistics of every row."""
    shown = docs.select(*keep)
    schema = T.StructType(shown.schema.fields + [T.StructField(s, T.LongType()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            found = [measure(t.as_py()) for t in batch.column(len(keep)).cast(pa.binary())]
            cols = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + cols, [*keep, *STATS])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


# --------------------------------------------------------------------------
# the list


def features() -> dict[str, Column]:
    """Derived statistics, as columns over STATS; ``feature_matrix`` has the same in numpy."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_char": F.col("n_symbols") / chars,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
    }


def feature_matrix(stats: np.ndarray) -> np.ndarray:
    n, chars, symbols, lines, repeats = stats.astype(float).T
    words, chars1 = np.maximum(n, 1), np.maximum(chars, 1)
    return np.column_stack([n, chars / words, symbols / chars1, lines / words, repeats / words])


@dataclass
class Rule:
    """A conjunction of (feature, is_at_least, threshold)."""

    conditions: list[tuple[str, bool, float]]
    covered: int = 0
    precision: float = 0.0

    def column(self) -> Column:
        cols = features()
        out = F.lit(True)
        for name, at_least, threshold in self.conditions:
            out = out & (cols[name] >= threshold if at_least else cols[name] < threshold)
        return out

    def mask(self, x: np.ndarray) -> np.ndarray:
        names = list(features_order())
        out = np.ones(len(x), bool)
        for name, at_least, threshold in self.conditions:
            v = x[:, names.index(name)]
            out &= v >= threshold if at_least else v < threshold
        return out

    def text(self) -> str:
        return " and ".join(f"{n} {'>=' if g else '<'} {t:.6g}" for n, g, t in self.conditions)


def features_order() -> tuple[str, ...]:
    return ("n_words", "chars_per_word", "symbols_per_char", "dup_lines_per_word", "repeat_share")


@dataclass
class DecisionList:
    """Ordered rules that reject; what no rule covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """Number (from 1) of the first rule that covers the row, 0 for none."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
        return F.lit(0) if out is None else out.otherwise(0)


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _best_condition(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, tuple[int, bool, float]] | None:
    """The threshold with the most gain on rows ``x`` with labels ``y``."""
    best = None
    p0, n0 = y.sum(), (~y).sum()
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, lab = x[order, j], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below = np.cumsum(lab)[cut - 1]
        for at_least in (True, False):
            p = p0 - below if at_least else below
            total = len(v) - cut if at_least else cut
            g = np.where(total >= least, _gain(p0, n0, p.astype(float), (total - p).astype(float)), -np.inf)
            k = int(np.argmax(g))
            if np.isfinite(g[k]) and (best is None or g[k] > best[0]):
                best = (float(g[k]), (j, at_least, float((v[cut[k]] + v[cut[k] - 1]) / 2)))
    return best


def learn_list(
    x: np.ndarray,
    bad: np.ndarray,
    max_rules: int = 12,
    max_conditions: int = 4,
    least_precision: float = 0.8,
    least_covered: int = 4,
    seed: int = 7,
) -> DecisionList:
    """Sequential covering of the rows marked ``bad``.  Order of rows must be stable."""
    names = features_order()
    out = DecisionList()
    part = np.random.default_rng(seed).permutation(len(x)) % 3
    grow, prune = part != 0, part == 0
    left = np.ones(len(x), bool)
    while len(out.rules) < max_rules and (bad & left & grow).any():
        inside = left & grow
        conditions: list[tuple[str, bool, float]] = []
        while len(conditions) < max_conditions and (~bad[inside]).any():
            found = _best_condition(x[inside], bad[inside], least_covered)
            if found is None or found[0] <= 1e-9:
                break
            j, at_least, threshold = found[1]
            conditions.append((names[j], at_least, threshold))
            inside = inside & Rule([conditions[-1]]).mask(x)
        if not conditions:
            break
        # Pruning: the shortest prefix of conditions with the best value on held-back rows.
        held = left & prune
        worth = []
        for k in range(1, len(conditions) + 1):
            m = Rule(conditions[:k]).mask(x) & held
            p, n = (bad & m).sum(), (~bad & m).sum()
            worth.append((p - n) / (p + n) if p + n else -1.0)
        rule = Rule(conditions[: int(np.argmax(worth)) + 1])
        m = rule.mask(x) & left
        rule.covered = int(m.sum())
        rule.precision = float(bad[m].mean()) if rule.covered else 0.0
        if rule.precision < least_precision or rule.covered < least_covered:
            break
        out.rules.append(rule)
        left &= ~m
    return out


def labelled_stats(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and badness of at most ``sample_rows`` labelled documents."""
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    chosen = bounded_sample(judged, judged.count(), sample_rows, F.col("doc_id"), F.col("quality"))
    # ``chosen`` has at most ``sample_rows`` rows, whatever the size of the tables.
    ids = F.broadcast(chosen.groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("quality").alias("_most")))
    known = docs.select("doc_id", "text").join(ids, "doc_id").where("_quality = _most")
    rows = text_stats(known, ("doc_id", "_quality"))
    rows = rows.orderBy("doc_id", *STATS).limit(sample_rows).collect()
    stats = np.array([[r[s] for s in STATS] for r in rows], np.int64).reshape(-1, len(STATS))
    return stats, np.array([r["_quality"] == 0 for r in rows], bool)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """The list for documents that pass the base rules."""
    stats, bad = labelled_stats(docs, labels, sample_rows)
    n, repeats = stats[:, 0], stats[:, 4]
    passed = ~((n < 50) | (100 * repeats > 50 * n))
    return learn_list(feature_matrix(stats[passed]), bad[passed])


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the statistics, base_failed, the rule that fired, and the verdict."""
    return (
        text_stats(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", rules.column())
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
