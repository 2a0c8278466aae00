"""Periodic runs of words: online dyadic square catching.

Words are appended to a stream.  For every power of two B the stream is cut into blocks of
B words, and each completed block is a catcher for squares whose period p lies in
[2B, 4B): the first half of such a square holds a whole block, so the block's words come
again p words later.  Every appended word completes one stretch of B words at each level;
it is compared with the two catchers that are 2B to 4B words behind it (by names of
stretches, each made of the names of its halves).  What matches is a suffix comparison
that advances while the words appended agree with those p words before.  When it covers p
words it is a square; squares of one period that overlap are one comparison, hence one run.

Many texts are one stream with a unique word between them, so no run crosses texts and
each level is a few numpy passes over all of them.  Work is O(n log n) in the words.

Null and empty texts have no run.  Repeated rows are reported as often as they come; rows
of an empty table give none.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD

#: A run is at least this long, and at least twice its period.
LEAST = 12
#: Words of texts that share a stream.
_TOGETHER = 20_000


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of stretches from the names of their halves."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + left


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at += len(differs)
        step *= 4
    return n


class SquareCatcher:
    """Runs of a stream of words (numbers); :attr:`runs` maps (start, end) to the period."""

    def __init__(self, least: int = LEAST):
        self.least = least
        self.words = np.empty(0, np.uint64)
        self.names: list[np.ndarray] = []  # of the stretches of 1, 2, 4, ... words
        self.waiting: list[np.ndarray] = []  # of each level: block and stretch, not yet decided
        self.open: list[tuple[int, int, int]] = []  # period, start, end of agreement so far
        self.runs: dict[tuple[int, int], int] = {}

    def _needed(self, period):
        """Words that must agree with those a period later."""
        return np.maximum(self.least, 2 * period) - period

    def _advance(self, period: int, start: int, end: int) -> None:
        """Carry a comparison on to the last word; keep it open, report it, or drop it."""
        end += _agreeing(self.words[end:], self.words[end + period :])
        if end + period == len(self.words):
            self.open.append((period, start, end))
        else:
            self._close(period, start, end)

    def _close(self, period: int, start: int, end: int) -> None:
        if end - start >= self._needed(period):
            key = (start, end + period)
            self.runs[key] = min(period, self.runs.get(key, period))

    def _name(self, level: int) -> int:
        """Name the stretches that are complete by now; gives the first new one."""
        if level == len(self.names):
            self.names.append(np.empty(0, np.uint64))
            self.waiting.append(np.empty((2, 0), np.int64))
        known, width = self.names[level], 1 << level
        first, total = len(known), len(self.words) - width + 1
        if level:
            half = self.names[level - 1]
            new = _mixed(half[first : total], half[first + width // 2 : total + width // 2])
        else:
            new = self.words[first:]
        self.names[level] = np.concatenate([known, new]) if first else new
        return first

    def _matches(self, level: int, first: int) -> np.ndarray:
        """Blocks and the new stretches they match, the first block of each comparison only."""
        names, width = self.names[level], 1 << level
        found = [self.waiting[level]]
        stretch = np.arange(first, len(names))
        for behind in (1, 2, 3) if level == 0 else (2, 3):
            s = stretch[stretch >= behind * width]
            block = (s // width - behind) * width
            hit = names[s] == names[block]
            s, block = s[hit], block[hit]
            before = (block >= width) & (names[np.maximum(block - width, 0)] == names[np.maximum(s - width, 0)])
            found.append(np.stack([block[~before], s[~before]]))
        return np.concatenate(found, axis=1)

    def _covered(self, level: int, block: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Matches inside a run of at most a block's period: their period is a multiple of it."""
        width = 1 << level
        known = [(a, e) for (a, e), q in self.runs.items() if q <= width and e - a >= 3 * width]
        known += [(a, e + q) for q, a, e in self.open if q <= width and e + q - a >= 3 * width]
        if not known:
            return np.zeros(len(s), bool)
        known.sort()
        starts = np.array([a for a, _ in known])
        reach = np.maximum.accumulate(np.array([e for _, e in known]))
        at = np.searchsorted(starts, block, side="right") - 1
        return (at >= 0) & (reach[np.maximum(at, 0)] >= s + width)

    def _catch(self, level: int, first: int) -> None:
        names, width = self.names[level], 1 << level
        block, s = self._matches(level, first)
        # A square reaches this far beyond the block, as its start is under a block before it.
        span = self._needed(s - block) - width + 1
        late = s + span > len(self.words)
        self.waiting[level] = np.stack([block[late], s[late]])
        block, s, span = block[~late], s[~late], span[~late]
        at = 0
        while len(s) and (further := at < span).any():
            there = np.minimum(at, np.maximum(span - width, 0))
            keep = ~further | (names[block + there] == names[s + there])
            block, s, span = block[keep], s[keep], span[keep]
            at += width
        inside = self._covered(level, block, s)
        for b, at in zip(block[~inside].tolist(), s[~inside].tolist()):
            back = _agreeing(self.words[max(b - width, 0) : b][::-1], self.words[max(at - width, 0) : at][::-1])
            self._advance(at - b, b - back, b + width)

    def append(self, words: np.ndarray) -> None:
        """The next words of the stream."""
        self.words = np.concatenate([self.words, np.asarray(words).astype(np.uint64)])
        held, self.open = self.open, []
        for period, start, end in held:
            self._advance(period, start, end)
        level = 0
        while 3 << level <= len(self.words) or not level:
            self._catch(level, self._name(level))
            level += 1

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of all runs, after the last word."""
        for period, start, end in sorted(self.open):
            self._close(period, start, end)
        self.open = []
        return sorted((a, e, q) for (a, e), q in self.runs.items())


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as a list of words."""
    numbers: dict = {}
    stream, first = [], [0]
    for words in texts:
        stream += [numbers.setdefault(w, len(numbers)) for w in words]
        stream.append(-1 - len(first))  # between texts, never equal to another word
        first.append(len(stream))
    catcher = SquareCatcher()
    catcher.append(np.array(stream, np.int64))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in catcher.finish():
        i = bisect_right(first, start) - 1
        out[i].append((start - first[i], end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what a run repeats: of each run its first period stays."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge).tolist()) if not inside]


def _groups(texts: list[list]) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, words in enumerate(texts):
        if i > first and total + len(words) > _TOGETHER:
            yield first, i
            first, total = i, 0
        total += len(words) + 1
    if first < len(texts):
        yield first, len(texts)


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def detect(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start and period),
    runs_sha256, collapsed_sha256 and, unless ``keep_text`` is false, the collapsed text."""
    fields = [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN))]
    fields += [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256", "collapsed")]
    schema = T.StructType([T.StructField("doc_id", fields[0].dataType), *fields[1 : None if keep_text else -1]])
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def emit(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts)
        left = [b" ".join(collapsed(w, r)) for w, r in zip(texts, found)]
        listed = ["".join("%d,%d,%d\n" % r for r in runs).encode() for runs in found]
        cols = [ids, pa.array([len(w) for w in texts], pa.int64())]
        cols.append(pa.array([[dict(zip(_RUN.names, r)) for r in runs] for runs in found], run_type))
        cols.append(pa.array([hashlib.sha256(v).hexdigest() for v in listed], pa.string()))
        cols.append(pa.array([hashlib.sha256(v).hexdigest() for v in left], pa.string()))
        if keep_text:
            cols.append(pa.array([v.decode() for v in left], pa.string()))
        return pa.RecordBatch.from_arrays(cols, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = part.column(1).cast(pa.large_binary()).to_pylist()
                texts = [(v or b"").split() for v in raw]  # of bytes: at ASCII white space
                for first, last in _groups(texts):
                    yield emit(part.column(0).slice(first, last - first), texts[first:last])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic ending planted in the documents whose id's crc32
    is divisible by 10 (none in rows without id or words)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.col("text").rlike(WORD)
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), words.alias("_words"))
    n, g = F.size("_words"), F.col("_g")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    split = split.select("doc_id", "text", "_words", n.alias("_n"), a.alias("_a"), p.alias("_p"))
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    endless = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", source(i)))
    planted = F.when(F.col("_words").isNotNull(), F.array_join(endless, " ")).otherwise(F.col("text"))
    return split.select("doc_id", planted.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: number of runs, its longest run, digests."""
    found = detect(with_repeats(docs), keep_text=False)
    best = F.reduce(
        "runs",
        F.lit(None).cast(_RUN),
        lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b),  # listed by start, period
    )
    top = found.withColumn("_best", best)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("_best")[n].alias(n) for n in _RUN.names],
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
