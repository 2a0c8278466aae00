"""Importance resampling of documents towards a target distribution.

Features are runs of words; each falls into one of a fixed number of buckets.  How often
the buckets occur in all documents and in all texts of the target gives each bucket a gain
(log ratio with one added to every bucket), kept as an array that documents score
themselves with.  Noise from the id's digest added to the mean gain makes the highest
scores a weighted draw without replacement (Gumbel top-k).

The order is made by parallel sorting by regular sampling.  Rows are dealt into as many
runs as there will be segments; each run is sorted where it is and written with its
places; regular samples of all runs give regular splitters; every run is cut at the
splitters, and what lies between two of them meets in one task, which merges it.  Prefix
sums of the segments' counts turn places in a segment into ranks.  Rows are ordered by
score, id, run and place, so no two are equal and a segment stays bounded however many
scores or rows are alike.  Segments behind the last drawn rank are not exchanged.

Null texts have no words; documents without a feature weigh 0; a null id is drawn with the
digest of the bare seed and comes after all ids.  Repeated rows are drawn one by one.  An
empty target gives every bucket the gain of a count of 0; an empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

#: Runs of letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a segment, and the most segments (the driver holds its square of samples).
_SEGMENT_ROWS, _MOST_SEGMENTS = 4096, 512


@dataclass(frozen=True)
class Resampling:
    """``longest``: words of a feature; ``least_words``: below it a document is not drawn;
    ``percent`` of the rest are."""

    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"({TERM})"), 1)


def _feature_buckets(terms: Column, p: Resampling) -> Column:
    """The bucket of every feature of a list of words."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % p.buckets).cast("int")

    def of_length(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(terms) - (n - 1))
        joined = F.transform(at, lambda i: bucket(F.array_join(F.slice(terms, i, F.lit(n)), " ")))
        return F.when(F.size(terms) >= n, joined).otherwise(F.array().cast("array<int>"))

    longer = [of_length(n) for n in range(2, p.longest + 1)]
    return F.concat(F.transform(terms, bucket), *longer) if longer else F.transform(terms, bucket)


def bucket_counts(texts: DataFrame, p: Resampling) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    found = texts.select(F.explode(_feature_buckets(words(F.col("text").cast("string")), p)).alias("bucket"))
    counts = np.zeros(p.buckets, np.int64)
    for row in found.groupBy("bucket").count().collect():  # at most one row a bucket
        counts[row["bucket"]] = row["count"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Of each bucket, a thousand times the log ratio of its smoothed shares, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    return [math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in pairs]


def scored(docs: DataFrame, gain: list[int], p: Resampling) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    # Folded to one literal array when the plan is optimised.
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    rows = docs.select("doc_id", words(F.col("text").cast("string")).alias("_words"))
    rows = rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), _feature_buckets(F.col("_words"), p).alias("_b"))
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(table, b))
    rows = rows.select("doc_id", "n_words", F.size("_b").cast("long").alias("n_features"), total.alias("_sum"))
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(_sum - pmod(_sum, n_features)) div n_features"))
    named = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = rows.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"), noise.alias("_noise"))
    return rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("_noise")).cast("long").alias("score"))


# --------------------------------------------------------------------------
# parallel sorting by regular sampling

#: The order of rows; ``run`` and ``place`` make every row distinct.
_ORDER = [F.desc, F.asc_nulls_last, F.asc, F.asc]
_KEYS = ["score", "doc_id", "run", "place"]


def _sorted_runs(rows: DataFrame, n_runs: int) -> DataFrame:
    """``rows`` dealt evenly into sorted runs, with the number of the run and the place in it."""
    schema = T.StructType([*rows.schema.fields, T.StructField("run", T.LongType()), T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            tags = [pa.array(np.full(n, run, np.int64)), pa.array(np.arange(place, place + n))]
            place += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *tags], schema.names)

    dealt = rows.repartition(n_runs).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
    return settle(dealt.mapInArrow(number, schema), "sorted-runs")


def _sort_key(row) -> tuple:
    return (-row["score"], row["doc_id"] is None, row["doc_id"] or 0, row["run"], row["place"])


def _splitters(runs: DataFrame, n_segments: int) -> list[tuple]:
    """Keys that cut all rows into ``n_segments`` of about one size, from regular samples."""
    sizes = {r["run"]: r["count"] for r in runs.groupBy("run").count().collect()}  # one row a run
    if n_segments < 2 or not sizes:
        return []
    size = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])[F.col("run")]
    step = lambda place: F.floor(place * F.lit(n_segments) / size)
    regular = (F.col("place") == 0) | (step(F.col("place")) > step(F.col("place") - 1))
    keys = sorted(map(_sort_key, runs.where(regular).select(*_KEYS).collect()))  # at most n_segments a run
    return [keys[i * len(keys) // n_segments] for i in range(1, n_segments)]


def _segmented(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``runs`` with the number of splitters before each row."""
    if not splitters:
        return runs.withColumn("segment", F.lit(0).cast("long"))
    marks = [np.array(column, np.int64) for column in zip(*splitters)]
    schema = T.StructType([*runs.schema.fields, T.StructField("segment", T.LongType())])
    at = [runs.columns.index(c) for c in _KEYS]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, doc, run, place = [batch.column(i) for i in at]
            keys = [-score.to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)]
            keys += [doc.fill_null(0).to_numpy(), run.to_numpy(), place.to_numpy()]
            order = np.lexsort([np.concatenate([k, m]) for k, m in zip(keys, marks)][::-1])
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(order >= batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before[: batch.num_rows])], schema.names)

    return runs.mapInArrow(cut, schema)


def ranked(rows: DataFrame, drawn: int, count: int) -> DataFrame:
    """``rows`` (doc_id a long, score) with the rank of the ``drawn`` highest of the ``count``."""
    n_segments = max(1, min(_MOST_SEGMENTS, -(-count // _SEGMENT_ROWS)))
    runs = _sorted_runs(rows, n_segments)
    dealt = _segmented(runs, _splitters(runs, n_segments))
    counts = {r["segment"]: r["count"] for r in dealt.groupBy("segment").count().collect()}  # one row a segment
    ahead, before = {}, 0
    for segment in sorted(counts):
        ahead[segment], before = before, before + counts[segment]
    met = [s for s in ahead if ahead[s] < drawn]
    last = max(met, default=-1)
    merged = Window.partitionBy("segment").orderBy(*[order(key) for order, key in zip(_ORDER, _KEYS)])
    first = F.create_map(*[F.lit(v) for s in met for v in (s, ahead[s])])[F.col("segment")] if met else F.lit(0)
    rank = first.cast("long") + F.row_number().over(merged)
    some = dealt.where(F.col("segment") <= last).withColumn("rank", rank)
    some = some.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = dealt.where(F.col("segment") > last).withColumn("rank", F.lit(None).cast("long"))
    names = [*rows.columns, "rank"]
    return some.select(*names).unionByName(rest.select(*names))


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document (rank null where
    not drawn).  Ids are whole numbers; both tables have a column ``text``."""
    gain = gains(bucket_counts(docs, p), bucket_counts(target, p))
    every = settle(scored(docs, gain, p).withColumn("doc_id", F.col("doc_id").cast("long")), "scored")
    enough = F.col("n_words") >= p.least_words
    count = every.where(enough).count()
    drawn = ranked(every.where(enough), p.percent * count // 100, count)
    return drawn.unionByName(every.where(~enough).withColumn("rank", F.lit(None).cast("long")))


#: DuckDB: crc32 by its table of 256 remainders, of each distinct word.
RESAMPLE_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
remainders AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS w FROM documents
),
target_terms AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS w FROM benchmark
),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM terms UNION SELECT w FROM target_terms)),
bucketed AS (
  SELECT w, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 10000 AS bucket
  FROM vocabulary, remainders
),
s AS (SELECT bucket, count(*) AS n FROM terms JOIN bucketed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_terms JOIN bucketed USING (w) GROUP BY bucket),
gain AS (
  SELECT i AS bucket, floor(1000 * ln(
      (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
      / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i
),
weighed AS (
  SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM terms JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY doc_id
),
every AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features,
    coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN weighed USING (doc_id)
),
scores AS (
  SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM every
),
places AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r,
    count(*) FILTER (n_features >= 20) OVER () AS eligible
  FROM scores
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= 10 * eligible // 100 THEN r END AS rank FROM places
"""
