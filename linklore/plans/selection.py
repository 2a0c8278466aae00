"""Exact order statistics of trailing frames that are too dense for arrays.

Radix selection by prefix counts: walk a value's digits from the highest.  At
each digit, count how many frame members share the digits found so far and have
each possible next digit; the wanted rank tells which digit to take.  A frame
count is the difference of two running counts, so every digit costs one prefix
pass over the log, whatever the frame's size, and no frame is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import Layout, materialize, running, scan

_BITS = 4
_DIGITS = 1 << _BITS


def _counts_at(elements: DataFrame, queries: DataFrame, keys: list[str], span_us: int, layout: Layout) -> DataFrame:
    """Per query the frame members of its prefix by next digit (``c``, an array).

    ``elements``: keys, at_us, seq, prefix, digit.  ``queries``: keys, at_us, seq,
    prefix and anything else.  The frame is [at - span, this row]."""
    payload = F.struct(*[c for c in queries.columns if c not in (*keys, "prefix")])
    points = queries.select(
        *keys,
        "prefix",
        payload.alias("q"),
        F.explode(
            F.array(
                # Before everything of that time; right after this row.
                F.struct((F.col("at_us") - span_us).alias("t"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("s")),
                F.struct(F.col("at_us").alias("t"), F.lit(1).alias("side"), F.col("seq").alias("s")),
            )
        ).alias("p"),
    ).select(*keys, "prefix", "q", "p.*", F.lit(1).alias("asks"))
    rows = elements.select(
        *keys, "prefix", F.col("at_us").alias("t"), F.lit(1).alias("side"), F.col("seq").alias("s"),
        F.lit(0).alias("asks"), "digit",
    ).unionByName(points, allowMissingColumns=True)
    segment = F.floor(F.col("t") / layout.segment_us).cast("bigint") if layout.split else None
    rows = scan(
        rows,
        [*keys, "prefix"],
        layout,
        ["t", "side", "s", "asks"],
        segment,
        **{f"n{d}": running((F.col("digit") == d).cast("int")) for d in range(_DIGITS)},
    )
    counts = F.array(*[F.col(f"n{d}") for d in range(_DIGITS)])
    ends = rows.where("asks = 1").groupBy(*keys, "prefix", "q").agg(
        F.max(F.when(F.col("side") == 0, counts)).alias("low"),
        F.max(F.when(F.col("side") == 1, counts)).alias("high"),
    )
    return ends.select(
        *keys, "prefix", "q.*", F.zip_with("high", "low", lambda a, b: a - b).alias("c")
    )


def _before(counts: Column, digit: Column) -> Column:
    """Members whose next digit is below ``digit``."""
    return F.aggregate(
        F.slice(counts, F.lit(1), digit), F.lit(0).cast("bigint"), lambda a, x: a + x
    )


def _digit_at(value: Column, level: int) -> Column:
    return F.shiftright(value, level * _BITS).bitwiseAND(F.lit(_DIGITS - 1)).cast("int")


def _levels(top: int) -> range:
    return range(max(1, -(-int(top).bit_length() // _BITS)) - 1, -1, -1)


def _prefixed(elements: DataFrame, keys: list[str], level: int) -> DataFrame:
    return elements.select(
        *keys,
        "at_us",
        "seq",
        F.shiftright("value", (level + 1) * _BITS).alias("prefix"),
        _digit_at(F.col("value"), level).alias("digit"),
    )


def frame_value_at_rank(
    elements: DataFrame, queries: DataFrame, keys: list[str], span_us: int, top: int, layout: Layout
) -> DataFrame:
    """``queries`` (keys, at_us, seq, name, rank) with ``value``: the member of
    0-based ``rank`` in the frame.  ``elements`` have a whole ``value`` >= 0, at
    most ``top``."""
    q = queries.withColumn("prefix", F.lit(0).cast("bigint"))
    for level in _levels(top):
        counted = _counts_at(_prefixed(elements, keys, level), q, keys, span_us, layout)
        upto = F.transform(
            F.sequence(F.lit(1), F.lit(_DIGITS)), lambda d: _before(F.col("c"), d)
        )
        digit = F.size(F.filter(upto, lambda n: n <= F.col("rank")))
        q = counted.withColumn("digit", digit).select(
            *keys,
            "at_us",
            "seq",
            "name",
            (F.col("rank") - _before(F.col("c"), F.col("digit"))).alias("rank"),
            (F.shiftleft("prefix", _BITS) + F.col("digit")).alias("prefix"),
        )
        q = materialize(q)
    return q.select(*keys, "at_us", "seq", "name", F.col("prefix").alias("value"))


def frame_count_above(
    elements: DataFrame, queries: DataFrame, keys: list[str], span_us: int, top: int, layout: Layout
) -> DataFrame:
    """``queries`` (keys, at_us, seq, n, limit) with ``above``: how many of the
    ``n`` frame members exceed ``limit``."""
    q = queries.withColumn("below", F.lit(0).cast("bigint"))
    for level in _levels(top):
        q = q.withColumn("prefix", F.shiftright("limit", (level + 1) * _BITS))
        counted = _counts_at(_prefixed(elements, keys, level), q, keys, span_us, layout)
        digit = _digit_at(F.col("limit"), level)
        # On the last digit, members equal to the limit are not above it either.
        stop = digit if level else digit + 1
        q = counted.withColumn("below", F.col("below") + _before(F.col("c"), stop)).drop("c", "prefix")
        q = materialize(q)
    return q.select(*keys, "at_us", "seq", (F.col("n") - F.col("below")).alias("above"))
