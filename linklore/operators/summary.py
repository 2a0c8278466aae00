"""Session summary, tallies, coverage, roams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..functions.text import duration
from ..plans.sequence import last_known, position, previous, running, running_min, scan
from ..sources.recording import BASE, STREAMS, Recording

SESSION = ["session_id"]

# Counter name of each event variant, and those tallied live.
COUNTERS = {
    "Wifi": "wifi",
    "Scan": "scan",
    "GatewayLatency": "gateway",
    "DnsLatency": "dns",
    "InterfaceCounters": "iface",
    "InterfaceStateChanged": "iface_state",
    "RoamDetected": "roam",
    "Finding": "findings",
    "SensorHealth": "health",
}
TALLIED = ("wifi", "scan", "gateway", "dns", "iface", "findings", "health")


def session_summary(rec: Recording) -> DataFrame:
    """Count, ends in file order, duration and per-variant counts.  Map-side
    partial aggregation leaves one row per session and task to shuffle."""
    counts = [
        F.count_if(F.col("event_type") == variant).alias(name)
        for variant, name in COUNTERS.items()
    ]
    df = rec.log().groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("envelope_count"),
        F.min_by("at_us", "seq").alias("first_us"),
        F.max_by("at_us", "seq").alias("last_us"),
        *counts,
    )
    secs = L.active_duration(F.col("first_us"), F.col("last_us"), rec.params)
    return df.withColumn("duration_secs", secs).withColumn(
        "duration_text", duration(secs, hours_with_seconds=True)
    )


def category_counts(rec: Recording) -> DataFrame:
    return (
        rec.log()
        .groupBy(*SESSION, L.category(F.col("event_type")).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def event_index(rec: Recording) -> DataFrame:
    """Dense 0-based position of every event of its session."""
    df = scan(rec.log().select(*BASE, "event_type"), SESSION, rec.layout, nth=position())
    return df.withColumn("event_index", F.col("nth") - 1).drop("nth")


def running_tally(rec: Recording) -> DataFrame:
    """Cumulative counts at the end of every status interval with events.  The
    windowed counts are summed first, so only interval rows are ordered."""
    step = rec.params.us(rec.params.tally_every)
    start = (F.floor(F.col("at_us") / step) * step).cast("bigint")
    names = {v: n for v, n in COUNTERS.items() if n in TALLIED}
    per_interval = rec.log().groupBy(*SESSION, start.alias("window_us")).agg(
        *[F.count_if(F.col("event_type") == v).alias(n) for v, n in names.items()]
    )
    return accumulate(per_interval)


def accumulate(per_interval: DataFrame) -> DataFrame:
    """Interval counts to running totals."""
    upto = (
        Window.partitionBy(*SESSION)
        .orderBy("window_us")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return per_interval.select(
        *SESSION, "window_us", *[F.sum(n).over(upto).alias(n) for n in TALLIED]
    )


def roams(rec: Recording) -> DataFrame:
    """Consecutive link rows on one SSID whose known BSSIDs differ."""
    df = scan(
        rec.wifi.select(*BASE, "ssid", "bssid", "rssi_dbm"),
        SESSION,
        rec.layout,
        prev=previous("ssid", "bssid", "rssi_dbm"),
    )
    prev = F.col("prev")
    moved = (prev["bssid"] != F.col("bssid")) & prev["ssid"].eqNullSafe(F.col("ssid"))
    return df.where(moved).select(
        *BASE,
        "ssid",
        prev["bssid"].alias("from_bssid"),
        F.col("bssid").alias("to_bssid"),
        prev["rssi_dbm"].alias("from_rssi_dbm"),
        F.col("rssi_dbm").alias("to_rssi_dbm"),
    )


# -- coverage --------------------------------------------------------------


def _covered(span_secs: Column, degraded: Column, window: int) -> Column:
    return F.coalesce(degraded, F.lit(False)) | F.coalesce(span_secs >= window, F.lit(False))


def coverage(rec: Recording) -> DataFrame:
    """Per session and expected source: has it delivered data over the wanted
    span, or reported that it cannot?"""
    p = rec.params
    data = F.col("event_type") != "SensorHealth"
    seen = rec.log().where(F.col("source").isin(*p.expected_sources)).groupBy(
        *SESSION, "source"
    ).agg(
        F.min_by("at_us", F.when(data, F.col("seq"))).alias("first_us"),
        F.max_by("at_us", F.when(data, F.col("seq"))).alias("last_us"),
        F.max_by("health_state", F.when(~data, F.col("seq"))).alias("state"),
    )
    wanted = rec.log().select(*SESSION).distinct().select(
        *SESSION, F.explode(F.array(*[F.lit(s) for s in p.expected_sources])).alias("source")
    )
    span = L.active_duration(F.col("first_us"), F.col("last_us"), p)
    return wanted.join(seen, [*SESSION, "source"], "left").select(
        *SESSION,
        "source",
        span.alias("span_secs"),
        F.coalesce(F.col("state") != "Operational", F.lit(False)).alias("degraded"),
        _covered(span, F.col("state") != "Operational", p.coverage_window).alias("satisfied"),
    )


def coverage_overall(rec: Recording) -> DataFrame:
    return coverage(rec).groupBy(*SESSION).agg(F.bool_and("satisfied").alias("satisfied"))


def coverage_time(rec: Recording) -> DataFrame:
    """First event at which every expected source is covered."""
    p = rec.params
    data = F.col("event_type") != "SensorHealth"
    df = rec.log().where(F.col("source").isin(*p.expected_sources))
    df = scan(
        df,
        [*SESSION, "source"],
        rec.layout,
        first=running_min(F.when(data, F.struct("seq", "at_us"))),
        latest_us=last_known(F.when(data, F.col("at_us"))),
        state=last_known(F.col("health_state")),
    )
    span = L.active_duration(F.col("first.at_us"), F.col("latest_us"), p)
    df = df.withColumn(
        "ok", _covered(span, F.col("state") != "Operational", p.coverage_window)
    )
    df = scan(
        df,
        SESSION,
        rec.layout,
        **{
            f"ok_{i}": last_known(F.when(F.col("source") == s, F.col("ok")))
            for i, s in enumerate(p.expected_sources)
        },
    )
    every = F.lit(True)
    for i in range(len(p.expected_sources)):
        every = every & F.coalesce(f"ok_{i}", F.lit(False))
    return df.where(every).groupBy(*SESSION).agg(
        F.min("seq").alias("seq"), F.min_by("at_us", "seq").alias("at_us")
    )
