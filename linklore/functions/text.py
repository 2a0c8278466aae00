"""Text rendering of numbers, as Column expressions.

``fixed`` prints exactly like the C and Rust formatters: the binary value is
rounded half-to-even.  Spark's ``format_string`` rounds the shortest decimal
text half-up (12.35 -> 12.4, although the stored value lies below 12.35), which
would change headlines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fraction bits that hold a double exactly from 1/16 up, and from 1/256 up; what
# is smaller rounds to zero at two decimals.  Times 100 both fit a BIGINT.
_FRACTION_BITS = 56
_SMALL_BITS = 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so it appears once in the tree."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(x: Column, digits: int, plus: bool = False) -> Column:
    """``x`` with up to two decimals; ``plus`` writes the sign of positives."""
    if not 0 <= digits <= 2:
        raise ValueError("0, 1 or 2 decimals")
    unit = 10**digits

    def split(v: Column) -> Column:
        size = F.abs(v)
        return let(
            F.struct(
                v.alias("v"),
                F.floor(size).cast("bigint").alias("whole"),
                (size - F.floor(size)).alias("fraction"),
                (size < 0.0625).alias("small"),
            ),
            scale,
        )

    def by_size(s: Column, value: Callable[[int], Column | int]) -> Column:
        return F.when(s["small"], value(_SMALL_BITS)).otherwise(value(_FRACTION_BITS))

    def scale(s: Column) -> Column:
        exact = s["fraction"] * by_size(s, lambda n: F.lit(float(1 << n)))
        bits = F.floor(exact).cast("bigint")
        return let(
            F.struct(
                s["v"].alias("v"),
                s["whole"].alias("whole"),
                s["small"].alias("small"),
                (bits * F.lit(unit).cast("bigint")).alias("scaled"),
            ),
            rounded,
        )

    def rounded(s: Column) -> Column:
        kept = s["whole"] * unit + by_size(s, lambda n: F.shiftright(s["scaled"], n))
        rest = by_size(s, lambda n: s["scaled"].bitwiseAND(F.lit((1 << n) - 1)))
        half = by_size(s, lambda n: F.lit(1 << (n - 1)))
        up = (rest > half) | ((rest == half) & (kept % 2 == 1))
        total = kept + F.when(up, 1).otherwise(0)
        return let(F.struct(s["v"].alias("v"), total.alias("total")), show)

    def show(s: Column) -> Column:
        sign = F.when(s["v"] < 0, "-").otherwise("+" if plus else "")
        whole = F.floor(s["total"] / unit).cast("bigint").cast("string")
        if not digits:
            return F.concat(sign, s["total"].cast("string"))
        part = F.lpad((s["total"] % unit).cast("string"), digits, "0")
        return F.concat(sign, whole, F.lit("."), part)

    return let(x.cast("double"), split)


def text(x: Column) -> Column:
    return x.cast("string")


def _ladder(x: Column, steps: list[tuple[float, int, str]], otherwise: Column) -> Column:
    out = None
    for size, digits, unit in steps:
        part = F.concat(fixed(x / F.lit(size), digits), F.lit(unit))
        out = F.when(x >= size, part) if out is None else out.when(x >= size, part)
    return out.otherwise(otherwise)


def rate(bps: Column) -> Column:
    """A bit rate with one unit per magnitude."""
    return let(bps, _rate)


def _rate(bps: Column) -> Column:
    steps = [(1e9, 2, " Gbps"), (1e6, 1, " Mbps"), (1e3, 0, " Kbps")]
    small = F.when(bps > 0, F.concat(fixed(bps, 0), F.lit(" bps"))).otherwise("idle")
    return _ladder(bps, steps, small)


def peak_rate(bps: Column) -> Column:
    """The coarser rate label used in rule evidence; null means no data."""
    label = _ladder(bps, [(1e6, 1, " Mbps"), (1e3, 0, " Kbps")], F.lit("idle"))
    return F.when(bps.isNull(), F.lit("no data")).otherwise(label)


def byte_size(n: Column) -> Column:
    x = n.cast("double")
    steps = [
        (1024.0**4, 1, "T"),
        (1024.0**3, 1, "G"),
        (1024.0**2, 1, "M"),
        (1024.0, 1, "K"),
    ]
    return _ladder(x, steps, F.concat(n.cast("bigint").cast("string"), F.lit("B")))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def duration(secs: Column, hours_with_seconds: bool = False) -> Column:
    """``1h02m`` / ``2m03s`` / ``4s``; optionally ``1h02m03s``."""
    secs = secs.cast("bigint")
    h = F.floor(secs / 3600).cast("bigint")
    m = F.floor((secs % 3600) / 60).cast("bigint")
    s = secs % 60
    hours = [h.cast("string"), F.lit("h"), _two(m), F.lit("m")]
    if hours_with_seconds:
        hours += [_two(s), F.lit("s")]
    return (
        F.when(h > 0, F.concat(*hours))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), _two(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )
