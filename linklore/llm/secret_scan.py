"""Secret scans: fixed patterns, and a battery of randomness tests on token-like runs.

Everything is Column expressions, one pass over whole texts and no shuffle of texts.
Positions are code points, ends exclusive.

Base kinds: ``assign``, ``access``, ``hex``.  The method adds kind ``random``: runs of 20
or more letters, digits and ``+/_-`` that overlap no base span and have a digit, or four
capitals and four small letters at least.  The encoding
is inferred from the characters used (hex, base 32, 36 or 64).  Against the hypothesis of
uniform independent symbols, a chi-squared test of the alphabet, a runs test about its
middle and a lag-1 serial correlation give three p-values; three times the least is the
token's.  Structured tokens are told apart by Benjamini-Hochberg over all tokens of a
length class, at a level that is higher for short ones, whose tests have less power; what
is not rejected is reported.  The bound follows the corpus: near 0 where all tokens of a class
look random, higher the more structured ones there are.  No token is rejected with a p-value
above ``MOST_MISSED``, so about that share of random tokens is missed at most.

Null and empty texts have no spans; repeated rows get equal results; an empty table gives
an empty result; a null id is carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeps_columns, settle

_VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({_VALUE}+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
_RUN = r"[A-Za-z0-9+/_-]"
_MIXED = "(?=(?:[a-z+/_-]*[A-Z]){4})(?=(?:[A-Z+/_-]*[a-z]){4})"
TOKEN = rf"(?<!{_RUN})(?:(?=[A-Za-z+/_-]*[0-9])|{_MIXED}){_RUN}{{20,}}"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets in order of preference; the first that holds every character is inferred.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: (least length, level of the false-discovery control) of each length class.
CLASSES = ((20, 0.30), (28, 0.20), (40, 0.10), (64, 0.05))
#: p-value up to which a token may be called structured, whatever the level allows.
MOST_MISSED = 0.03
_BINS = 1000


def _running(values: Column) -> Column:
    """Running sums with a leading 0, in two levels so that long arrays stay cheap."""

    def scan(arr: Column, start: Column) -> Column:
        return F.aggregate(arr, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    zero = F.lit(0).cast("long")
    step = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), step - 1), lambda c: F.slice(values, c * step + 1, step))
    total = lambda arr: F.aggregate(arr, zero, lambda acc, x: acc + x)
    starts = F.slice(scan(F.transform(parts, total), zero), F.lit(1), step)
    inner = F.zip_with(parts, starts, lambda arr, s: F.slice(scan(arr, s), F.lit(1), F.size(arr)))
    return F.concat(F.flatten(inner), F.array(total(values)))


def _positions(text: Column, pattern: str, found: Column) -> Column:
    """(start, end) of each match; ``found``: the matches."""
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    ends = _running(F.transform(both, lambda x: (x.g + x.m).cast("long")))
    return F.zip_with(
        F.slice(ends, F.lit(2), F.size(found)), both, lambda e, x: F.struct((e - x.m).alias("start"), e.alias("end"))
    )


_SPAN = "array<struct<start:bigint,place:int,end:bigint>>"


def _spans(text: Column, pattern: str, place: int, good: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of the matches whose ``group`` is ``good``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.transform(
        _positions(text, pattern, found), lambda x: F.struct(x.start.alias("start"), F.lit(place).alias("place"), x.end.alias("end"))
    )
    if good is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        kept = F.filter(F.zip_with(spans, values, lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: good(x.v))
        spans = F.transform(kept, lambda x: x.s)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


# --------------------------------------------------------------------------
# the battery


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _alphabet(token: Column) -> Column:
    out = F.lit(ALPHABETS[-1][1])
    for _, alphabet in reversed(ALPHABETS[:-1]):
        out = F.when(token.rlike(f"^[{alphabet}]+$"), F.lit(alphabet)).otherwise(out)
    return out


def _place(alphabet: Column, char: Column) -> Column:
    """Number of a character in its alphabet; + and - share one, as do / and _."""
    at = F.call_function("locate", char, alphabet) - 1
    return F.when(at >= 64, at - 2).otherwise(at).cast("double")


def token_p(tokens: Column) -> Column:
    """For each token, the probability of looking less random, were it random."""
    one = F.transform(tokens, lambda t: F.struct(t.alias("t"), _alphabet(t).alias("a")))
    two = F.transform(
        one,
        lambda s: F.struct(
            F.transform(F.split(s.t, ""), lambda c: _place(s.a, c)).alias("v"),
            F.least(F.length(s.a), F.lit(64)).cast("double").alias("k"),
        ),
    )
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)

    def sums(s: Column) -> Column:
        v, n = s.v, F.size(s.v)
        first, second = F.slice(v, F.lit(1), n - 1), F.slice(v, F.lit(2), n - 1)
        half = s.k / 2
        changes = F.zip_with(first, second, lambda a, b: F.when((a >= half) != (b >= half), 1.0).otherwise(0.0))
        return F.struct(
            s.k.alias("k"),
            n.cast("double").alias("n"),
            add(F.transform(F.array_distinct(v), lambda x: F.pow(n - F.size(F.array_remove(v, x)), 2.0))).alias("squares"),
            (add(changes) + 1).alias("runs"),
            F.size(F.filter(v, lambda x: x >= half)).cast("double").alias("high"),
            add(v).alias("sum"),
            add(F.transform(v, lambda x: x * x)).alias("sum2"),
            add(F.zip_with(first, second, lambda a, b: a * b)).alias("lag"),
            (F.element_at(v, 1) * F.element_at(v, -1)).alias("ring"),
        )

    def p(s: Column) -> Column:
        df = s.k - 1
        chi = F.greatest(s.k / s.n * s.squares - s.n, F.lit(0.0))
        z = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high, low = s.high, s.n - s.high
        mean = 2 * high * low / s.n + 1
        var = (mean - 1) * (mean - 2) / (s.n - 1)
        runs = F.when(var > 0, 2 * _upper_tail(F.abs(s.runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
        spread = s.n * s.sum2 - s.sum * s.sum
        r = (s.n * (s.lag + s.ring) - s.sum * s.sum) / F.greatest(spread, F.lit(1e-9))
        z_r = (r + 1 / (s.n - 1)) * F.sqrt(s.n)
        serial = F.when(spread > 0, 2 * _upper_tail(F.abs(z_r))).otherwise(0.0)
        return F.least(F.lit(1.0), 3 * F.least(_upper_tail(z), runs, serial))

    return F.transform(F.transform(two, sums), p)


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, (least, _) in enumerate(CLASSES[1:], 1):
        out = F.when(n >= least, i).otherwise(out)
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (spans of the base kinds, in order) and ``_tokens`` (start, end, p of candidates)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 8, 1),
            _spans(text, ACCESS, 1),
            _spans(text, HEX, 2),
        )
    )
    out = docs.withColumn("_base", base)
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    spans = F.zip_with(_positions(text, TOKEN, found), found, lambda s, t: F.struct(s.start.alias("start"), s.end.alias("end"), t.alias("t")))
    apart = F.filter(spans, lambda s: ~F.exists("_base", lambda b: (b.start < s.end) & (s.start < b.end)))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,t:string>>")
    out = out.withColumn("_free", F.when(text.rlike(TOKEN), apart).otherwise(empty))
    p = token_p(F.transform("_free", lambda s: s.t))
    return out.withColumn(
        "_tokens", F.zip_with("_free", p, lambda s, x: F.struct(s.start.alias("start"), s.end.alias("end"), x.alias("p")))
    ).drop("_free")


def thresholds(docs: DataFrame) -> dict[int, float]:
    """For each length class, the p-value up to which Benjamini-Hochberg rejects randomness, at most ``MOST_MISSED``.

    p-values are counted in bins of 0.001, so what is gathered has a fixed size.
    """
    return limits_of(scanned(docs.select("text")))


def limits_of(found: DataFrame) -> dict[int, float]:
    """:func:`thresholds` of texts that are scanned already."""
    each = found.select(F.explode("_tokens").alias("x"))
    bins = each.select(
        _length_class(F.col("x.end") - F.col("x.start")).alias("cls"), F.ceil(F.col("x.p") * _BINS).cast("int").alias("bin")
    )
    counts: dict[int, dict[int, int]] = {}
    for r in bins.groupBy("cls", "bin").count().collect():  # at most 4 * 1001 rows
        counts.setdefault(r["cls"], {})[r["bin"]] = r["count"]
    out = {}
    for cls, found in counts.items():
        total, below, limit = sum(found.values()), 0, 0.0
        for b in sorted(found):
            below += found[b]
            if b / _BINS <= CLASSES[cls][1] * below / total:
                limit = b / _BINS
        out[cls] = min(limit, MOST_MISSED)
    return out


def _is_random(token: Column, limits: dict[int, float]) -> Column:
    """Not rejected by the control of its class."""
    cls = _length_class(token.end - token.start)
    bound = F.lit(0.0)
    for i, limit in limits.items():
        bound = F.when(cls == i, F.lit(limit)).otherwise(bound)
    return token.p > bound


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_all``: sorted spans (start, place, end) of base kinds and of all kinds.

    Texts are scanned twice, as keeping them beside their spans would write them once more."""
    return judged(scanned(docs), thresholds(docs))


def judged(found: DataFrame, limits: dict[int, float]) -> DataFrame:
    """Scanned rows with ``_all`` in place of ``_tokens``."""
    extra = F.transform(
        F.filter("_tokens", lambda t: _is_random(t, limits)),
        lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("place"), t.end.alias("end")),
    )
    return found.withColumn("_all", F.array_sort(F.concat("_base", extra))).drop("_tokens")


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s.place), s.start.cast("string"), s.end.cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    # Spans are small beside the texts: written once, they serve the control and the result.
    found = settle(scanned(docs.select("doc_id", "text")).drop("text"), "secret-spans")
    found = judged(found, limits_of(found))
    n = lambda place: F.size(F.filter("_base", lambda s: s.place == place)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("_all")).alias("spans"),
    )


@keeps_columns("text")
def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; rows and columns stay."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col("text"), (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        fresh = F.struct(s.end.alias("at"), F.concat(acc.parts, F.array(piece, F.lit(mask))).alias("parts"))
        inside = F.struct(F.greatest(acc.at, s.end).alias("at"), acc.parts.alias("parts"))
        return F.when(s.start >= acc.at, fresh).otherwise(inside)

    def finish(acc: Column) -> Column:
        rest = F.substring(F.col("text"), (acc.at + 1).cast("int"), F.length("text"))
        return F.array_join(F.concat(acc.parts, F.array(rest)), "")

    names = docs.columns
    text = F.when(F.size("_all") > 0, F.aggregate("_all", start, step, finish)).otherwise(F.col("text"))
    return scan(docs).withColumn("text", text).select(*names)
