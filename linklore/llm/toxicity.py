"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is the bag of its character runs of 3 to 5 bytes, ends marked, and the whole
word; each run has a vector in a hashed table.  The vectors of a window of ``WINDOW``
words are averaged and go through a linear softmax; embeddings and softmax are trained
together, in numpy, by stochastic gradients on a bounded sample of labelled rows.  A
misspelt word shares most of its runs with the word, so it needs no example of its own.

A text is as toxic as its most toxic window, so a long text cannot dilute a few words.
In training, a toxic text teaches through its currently highest window and a clean one
through its highest and some random ones.  Training and the decision cut read whole texts,
as scoring does; where texts are so long that the sample would hold more than
``SAMPLE_CHARS`` code points, it has fewer rows.

Null and empty texts have the score of the bias alone, at most 0.49.  Repeated rows get
equal scores; labels that contradict each other are left out; without labels of both
kinds every score is near 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fold, parts_of
from .rolling import Prefixes, grouped, segments, word_bounds

#: Rows of the embedding table.
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
#: Words averaged into one prediction, and the distance of windows.
WINDOW, STRIDE = 1, 1
#: Labelled rows the model is trained on, at most, half of each label.
SAMPLE_ROWS = 3000
#: Code points after which no more training texts are taken, half of them of each label.
SAMPLE_CHARS = 18_000_000
#: Training texts a run must occur in.
LEAST_TEXTS = 3
#: Bytes of texts scored in one go.
_TOGETHER = 1 << 18
#: Share of windows hidden in a training step.
_HIDDEN = 0.4
_EDGE = np.isin(np.arange(256), list(b".,;:!?\"'()[]|"))


def _words(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words of a segment, without punctuation at their ends."""
    starts, ends = word_bounds(part)
    if len(starts):
        for _ in range(3):
            starts = starts + (_EDGE[part[starts]] & (starts < ends - 1))
            ends = ends - (_EDGE[part[ends - 1]] & (ends > starts + 1))
    return starts, ends


def runs(raw: bytes) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each segment where its words begin and, for each size of run (first the whole
    word), the buckets in order of words and how many each word has."""
    data = np.frombuffer(raw, np.uint8)
    for a, b in segments(raw):
        part = data[a:b]
        starts, ends = _words(part)
        if not len(starts):
            continue
        sums, length = Prefixes(part), ends - starts
        stop = np.zeros(len(part), np.int64)
        step = np.zeros(len(part) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        inside = np.flatnonzero(np.cumsum(step[:-1]))
        stop[inside] = np.repeat(ends, length)
        first = np.zeros(len(part), np.uint64)
        first[starts] = 1
        bucket = lambda h: ((h >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        found = [(bucket(sums.runs(starts, ends)), np.ones(len(starts), np.int64))]
        for size in SIZES:
            at = inside[stop[inside] >= inside + size]
            mark = first[at] + np.uint64(2) * (stop[at] == at + size).astype(np.uint64) + np.uint64(4 * size)
            h = sums.runs(at, at + size) + mark * np.uint64(0x9E3779B97F4A7C15)
            found.append((bucket(h), np.maximum(length - size + 1, 0)))
        yield starts + a, found


@dataclass
class Model:
    """``weight``: logit of each bucket (embedding times softmax difference), ``bias``."""

    weight: np.ndarray
    bias: float

    def word_logits(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Mean logit of the runs of each word, and where it begins."""
        parts, places = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        for starts, found in runs(raw):
            total, count = np.zeros(len(starts)), np.zeros(len(starts))
            for bucket, n in found:
                sums = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
                after = np.cumsum(n)
                total += sums[after] - sums[after - n]
                count += n
            parts.append((total / count).astype(np.float32))
            places.append(starts)
        return np.concatenate(parts), np.concatenate(places)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """The logit of the most toxic window of each text; minus infinity without words."""
        out = np.full(len(texts), -np.inf)
        for a, b in grouped(texts, _TOGETHER):
            part = texts[a:b]
            x, places = self.word_logits(b" ".join(part).lower())
            first = np.cumsum([0] + [len(t) + 1 for t in part])
            bounds = np.searchsorted(places, first)
            for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]), a):
                if hi > lo:
                    out[i] = window_means(x[lo:hi]).max() + self.bias
        return out


def _bags(raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets in order of words, and where each word begins."""
    buckets, counts = [], []
    for starts, found in runs(raw):
        words = len(starts)
        owner = np.concatenate([np.repeat(np.arange(words), n) for _, n in found])
        order = np.argsort(owner, kind="stable")
        buckets.append(np.concatenate([b for b, _ in found])[order].astype(np.int32))
        counts.append(np.bincount(owner, minlength=words))
    if not buckets:
        return None
    return np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def window_means(x: np.ndarray) -> np.ndarray:
    """Means of windows of WINDOW words, STRIDE apart, the last one at the end."""
    if WINDOW == 1:
        return x
    if len(x) <= WINDOW:
        return np.array([x.mean()])
    sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    starts = np.append(np.arange(0, len(x) - WINDOW, STRIDE), len(x) - WINDOW)
    return (sums[starts + WINDOW] - sums[starts]) / WINDOW


def train(
    texts: list[bytes], toxic: list[int], size: int = 8, steps: int = 30_000, whole: int = 3000, rate: float = 0.12, seed: int = 3
) -> Model:
    """Embeddings (BUCKETS x size) and a softmax of two classes, jointly, by Adagrad."""
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS, size)) - 0.5) / size).astype(np.float32)
    soft = (rng.standard_normal((2, size)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    spread = np.full(BUCKETS, 1e-2, np.float32)
    bags = [_bags(raw) for raw in texts]
    # Runs of a single text say nothing about others: they keep the vector 0.
    texts_with = np.zeros(BUCKETS, np.int64)
    for bag in bags:
        if bag is not None:
            texts_with[np.unique(bag[0])] += 1
    known = (texts_with >= LEAST_TEXTS)[:, None]
    table *= known
    share = np.array([1.0 / max(1, toxic.count(v)) for v in toxic])
    scale = share / share.mean()

    def learn(i: int, used: np.ndarray, per: np.ndarray, weight: float, step: float) -> None:
        """One gradient step on a bag: ``per`` is the part of each run in the average."""
        nonlocal soft, bias
        v = per @ table[used]
        z = soft @ v + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[toxic[i]] -= 1
        p *= weight
        back = p @ soft
        soft = soft - 0.1 * step * np.outer(p, v).astype(np.float32)
        bias = bias - 0.02 * step * p.astype(np.float32)
        grad = per[:, None] * back * known[used]
        np.add.at(spread, used, (grad * grad).mean(axis=1))
        change = -step * grad / np.sqrt(spread[used])[:, None]
        np.add.at(table, used, change.astype(np.float32))
        logit[used] = table[used] @ (soft[1] - soft[0])

    # First whole texts, which ranks the words; then windows.
    logit = table @ (soft[1] - soft[0])
    turn = np.concatenate([rng.permutation(len(texts)) for _ in range(1 + whole // len(texts))])[:whole]
    for i in turn:
        if bags[i] is not None:
            bucket, first = bags[i]
            n = np.diff(first)
            learn(i, bucket, np.repeat(1 / n, n) / len(n), scale[i], rate)
    spread[:] = 1e-2
    epochs = max(10, steps // len(texts))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        logit = table @ (soft[1] - soft[0])
        for i in rng.permutation(len(texts)):
            if bags[i] is None:
                continue
            bucket, first = bags[i]
            n = len(first) - 1
            per_word = np.add.reduceat(logit[bucket], first[:-1]) / np.diff(first)
            means = window_means(per_word)
            starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW) if n > WINDOW else np.zeros(1, int)
            top = int(np.argmax(means))
            if toxic[i]:
                # Hiding some windows lets every toxic word teach, not only the strongest;
                # when only clearly clean ones are left, the strongest teaches after all.
                seen = np.where(rng.random(len(means)) < _HIDDEN, -np.inf, means)
                second = int(np.argmax(seen))
                if seen[second] + bias[1] - bias[0] > -2:
                    top = second
            picks = {top} if toxic[i] else {top, int(rng.integers(len(means)))}
            for k in picks:
                lo, hi = starts[k], min(starts[k] + WINDOW, n)
                count = np.diff(first[lo : hi + 1])
                learn(i, bucket[first[lo] : first[hi]], np.repeat(1 / count, count) / (hi - lo), scale[i] / len(picks), step)
    model = Model(table @ (soft[1] - soft[0]), float(bias[1] - bias[0]))
    return Model(model.weight, model.bias - _cut(model.logits(texts), np.array(toxic, bool)))


def _cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The logit that parts training texts best; a clean text wrongly called toxic counts
    five times.  Of equally good ones, the middle."""
    grid = np.arange(-2, 4.01, 0.1)
    loss = [(z[toxic] < c).mean() + 5 * (z[~toxic] >= c).mean() for c in grid]
    best = np.flatnonzero(np.isclose(loss, min(loss)))
    return float(grid[best].mean())


# --------------------------------------------------------------------------
# on tables


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null id is one of them."""
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most ``sample_rows`` labelled documents outside the held-out fold, half of
    each label, and whole; fewer once they hold ``sample_chars`` code points."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    known = known.where("toxic = _most").select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for value in (0, 1):
        some = bounded_sample(known.where(F.col("toxic") == value), counts.get(value, 0), sample_rows // 2, F.col("doc_id"))
        chosen = some if chosen is None else chosen.union(some)
    # At most ``sample_rows`` ids, whatever the size of the tables.
    texts = docs.select("doc_id", F.col("text").alias("_text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").where("length(_text) > 0")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_text")]
    earlier = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.length("_text").cast("long")).over(earlier), F.lit(0)))
    rows = rows.where(F.col("_before") < sample_chars // 2).orderBy(*order).limit(sample_rows).collect()
    return train([r["_text"].lower().encode() for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every row."""
    shown = docs.select(*keep)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    names = [*keep, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            raw = [v or b"" for v in batch.column(len(keep)).cast(pa.large_binary()).to_pylist()]
            z = model.logits(raw)
            p = 1 / (1 + np.exp(-np.clip(np.where(np.isinf(z), min(model.bias, -0.04), z), -40, 40)))
            cols = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + cols, names)

    asked = docs.select(*keep, F.col(text).alias("_text"))
    return asked.mapInArrow(run, T.StructType(shown.schema.fields + fields))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs, fit(docs, labels, sample_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
