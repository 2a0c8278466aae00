"""Moments of a recording worth a look, derived from its events.

Gateway and throughput stances must hold before they count, and a landmark is
anchored where the stance *began*: ``seq`` / ``at_us`` name that event, while
``commit_seq`` is the event that confirmed it and orders the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..functions.text import fixed, rate
from ..plans.sequence import last_known, position, previous, running, running_min, scan, spread
from ..sources.recording import BASE, Recording
from . import windows as W
from .timeline import INSTANT, slice_of

SESSION = ["session_id"]
COLUMNS = ["session_id", "commit_seq", "seq", "at_us", "category", "severity", "headline"]


def _landmark(
    df: DataFrame, category: str, severity: Column, headline: Column, commit_seq: str = "seq"
) -> DataFrame:
    return df.select(
        "session_id",
        F.col(commit_seq).alias("commit_seq"),
        "seq",
        "at_us",
        F.lit(category).alias("category"),
        severity.alias("severity"),
        headline.alias("headline"),
    )


def from_findings(findings: DataFrame) -> DataFrame:
    """One per finding event; every one is a transition already."""
    worse = F.col("lifecycle").isin("Active", "Escalating")
    return _landmark(
        findings,
        "Finding",
        F.when(worse, "Alarm").otherwise("Recovery"),
        F.concat("lifecycle", F.lit(" \u00b7 "), "headline"),
    )


def published(rec: Recording, found: DataFrame) -> DataFrame:
    """Derived findings with the ``seq`` of the event they follow, so that they
    take their place in the log."""
    events = rec.log().select(
        "session_id", "at_us", F.lit(0).alias("is_tick"), F.col("seq").alias("tie"),
        F.lit(0).alias("is_finding"), F.col("seq").alias("event_seq"),
    )
    rows = found.withColumn("tie", F.col("seq")).drop("seq").withColumn("is_finding", F.lit(1))
    df = scan(
        spread(events.unionByName(rows, allowMissingColumns=True), rec.layout),
        SESSION,
        rec.layout,
        ["at_us", "is_tick", "tie", "is_finding"],
        slice_of(rec.layout),
        seq=last_known(F.col("event_seq")),
    )
    return df.where("is_finding = 1").drop("is_finding", "tie", "event_seq", "is_tick")


def health_changes(rec: Recording) -> DataFrame:
    """Health rows whose state differs from the sensor's previous one."""
    df = scan(spread(rec.health, rec.layout), ["session_id", "sensor"], rec.layout, prev=previous("state"))
    return df.where(F.col("prev").isNull() | (F.col("prev.state") != F.col("state"))).withColumn(
        "prev_state", F.col("prev.state")
    ).drop("prev")


def from_health(rec: Recording) -> DataFrame:
    """State changes per sensor; a sensor that starts healthy is no landmark."""
    df = health_changes(rec)
    up = F.col("state") == "Operational"
    first = F.col("prev_state").isNull()
    df = df.where(~(first & up))
    headline = F.when(
        up, F.concat("sensor", F.lit(" recovered (was "), "prev_state", F.lit(")"))
    ).otherwise(F.concat("sensor", F.lit(" \u2192 "), "state"))
    return _landmark(df, "Health", F.when(up, "Recovery").otherwise("Alarm"), headline)


def gateway_stances(rec: Recording) -> DataFrame:
    """Probes with stance and the last time the link was seen active."""
    probes = W.rolling_median(rec).select(
        *BASE,
        F.lit(True).alias("is_probe"),
        "target",
        "rtt_ms",
        L.gateway_stance(
            F.col("reachable"), F.col("rtt_ms"), F.col("median_ms"), rec.params
        ).alias("stance"),
    )
    busy = W.step_rate(rec).where("regime <> 'idle'").select(*BASE, F.lit(False).alias("is_probe"))
    df = scan(
        spread(probes.unionByName(busy, allowMissingColumns=True), rec.layout),
        SESSION,
        rec.layout,
        active_us=last_known(F.when(~F.col("is_probe"), F.col("at_us"))),
    )
    return df.where("is_probe").drop("is_probe")


def _runs(df: DataFrame, value: str, rec: Recording) -> DataFrame:
    """Number the runs of equal ``value``."""
    df = scan(df, SESSION, rec.layout, prev=previous(value))
    changed = ~F.col(f"prev.{value}").eqNullSafe(F.col(value))
    df = df.withColumn("changed", changed.cast("int")).drop("prev")
    return scan(df, SESSION, rec.layout, run=running(F.col("changed"))).drop("changed")


def from_gateway(rec: Recording) -> DataFrame:
    p = rec.params
    hold = p.gateway_hold_probes
    df = _runs(gateway_stances(rec), "stance", rec)
    df = scan(df, [*SESSION, "run"], rec.layout, nth=position())
    row = F.struct("seq", "at_us", "rtt_ms", "target", "active_us")
    kept = (
        df.where(F.col("nth").isin(1, hold))
        .groupBy(*SESSION, "run", "stance")
        .agg(
            F.max(F.when(F.col("nth") == 1, row)).alias("start"),
            F.max(F.when(F.col("nth") == hold, row)).alias("commit"),
        )
        .where("commit is not null")
        .withColumn("seq", F.col("commit.seq"))
    )
    kept = scan(kept, SESSION, rec.layout, prev=previous("stance"))
    before = F.col("prev.stance")
    news = F.when(before.isNull(), F.col("stance") != "stable").otherwise(
        before != F.col("stance")
    )
    idle_secs = L.whole_seconds(F.col("commit.at_us") - F.col("commit.active_us"), p)
    waking = F.coalesce(idle_secs >= p.wakeup_idle, F.lit(True))
    target = F.col("commit.target")
    reading = F.concat(target, F.lit(" "), fixed(F.col("start.rtt_ms"), 1), F.lit(" ms"))
    stable, spiking = F.col("stance") == "stable", F.col("stance") == "spiking"
    headline = (
        F.when(stable, F.concat(F.lit("Gateway recovered \u00b7 "), reading))
        .when(
            spiking & waking,
            F.concat(F.lit("Gateway latency rose \u00b7 "), reading, F.lit(" \u00b7 wakeup likely")),
        )
        .when(spiking, F.concat(F.lit("Gateway spiking \u00b7 "), reading))
        .otherwise(F.concat(F.lit("Gateway unreachable \u00b7 "), target))
    )
    severity = (
        F.when(stable, "Recovery").when(spiking & waking, "Notable").otherwise("Alarm")
    )
    df = kept.where(news).select(
        "session_id",
        F.col("seq").alias("commit_seq"),
        F.col("start.seq").alias("seq"),
        F.col("start.at_us").alias("at_us"),
        severity.alias("severity"),
        headline.alias("headline"),
    )
    return _landmark(df, "Gateway", F.col("severity"), F.col("headline"), "commit_seq")


def from_dns(rec: Recording) -> DataFrame:
    """Every flip between answering and failing, queries mixed."""
    df = scan(spread(rec.dns, rec.layout), SESSION, rec.layout, prev=previous("answered"))
    df = df.where(F.col("prev.answered") != F.col("answered"))
    via = F.concat("query", F.lit(" via "), "resolver")
    why = F.coalesce(F.concat(F.lit(" ("), "error", F.lit(")")), F.lit(""))
    up = F.col("answered")
    return _landmark(
        df,
        "Dns",
        F.when(up, "Recovery").otherwise("Alarm"),
        F.when(up, F.concat(F.lit("DNS recovered \u00b7 "), via)).otherwise(
            F.concat(F.lit("DNS failing \u00b7 "), via, why)
        ),
    )


def _regime_word(regime: Column) -> Column:
    return F.when(regime == "trickle", "trickling").otherwise(regime)


def from_throughput(rec: Recording) -> DataFrame:
    p = rec.params
    df = _runs(W.step_rate(rec), "regime", rec)
    df = scan(df, [*SESSION, "run"], rec.layout, begun=running_min(F.struct("seq", "at_us")))
    held = L.whole_seconds(F.col("at_us") - F.col("begun.at_us"), p) >= p.throughput_hold
    kept = (
        df.groupBy(*SESSION, "run", "regime")
        .agg(
            F.min(F.struct("seq", "at_us", "rx_bps", "tx_bps")).alias("start"),
            F.min(F.when(held, F.col("seq"))).alias("seq"),
        )
        .where("seq is not null")
    )
    kept = scan(kept, SESSION, rec.layout, prev=previous("regime"))
    before, now = F.col("prev.regime"), F.col("regime")
    quiet, high = ("idle", "trickle"), ("sustained", "bursting")
    news = (
        F.when(before.isNull(), now.isin(*high))
        .when(before == now, False)
        .when(now == "bursting", True)
        .when(now == "sustained", before.isin(*quiet))
        .otherwise((now == "idle") & before.isin(*high))
    )
    headline = F.concat(
        F.lit("Throughput "),
        _regime_word(F.coalesce(before, now)),
        F.lit(" \u2192 "),
        _regime_word(now),
        F.lit(" \u00b7 RX "),
        rate(F.col("start.rx_bps")),
        F.lit(" / TX "),
        rate(F.col("start.tx_bps")),
    )
    df = kept.where(news).select(
        "session_id",
        F.col("seq").alias("commit_seq"),
        F.col("start.seq").alias("seq"),
        F.col("start.at_us").alias("at_us"),
        F.when(now.isin(*high), "Notable").otherwise("Recovery").alias("severity"),
        headline.alias("headline"),
    )
    return _landmark(df, "Throughput", F.col("severity"), F.col("headline"), "commit_seq")


def landmarks(rec: Recording) -> DataFrame:
    """All families over the recorded events."""
    parts = [from_findings(rec.findings)] if "findings" in rec.streams else []
    parts += [from_health(rec), from_gateway(rec), from_dns(rec), from_throughput(rec)]
    return reduce(DataFrame.unionByName, parts)


def around_playhead(marks: DataFrame, playheads: DataFrame, rec: Recording) -> DataFrame:
    """Current, next and previous landmark of each playhead
    (``session_id``, ``playhead_seq``).

    The list is walked in commit order although anchors may lie earlier, so
    *current* is the last entry before the first one past the playhead."""
    keys = ["session_id", "playhead_seq"]
    ph = F.col("playhead_seq")
    past = F.col("seq") > ph
    segment = None
    if rec.layout.split:
        segment = F.floor(F.coalesce("commit_seq", ph) / rec.layout.segment_rows).cast("bigint")
    df = scan(
        spread(playheads, rec.layout).join(spread(marks, rec.layout), "session_id", "left"),
        keys,
        rec.layout,
        ["commit_seq", "category"],
        segment,
        past_n=running(past.cast("int")),
    )
    order = F.struct("commit_seq", "category")
    open_ = (F.col("past_n") == 0) & F.col("commit_seq").isNotNull()
    return df.groupBy(*keys).agg(
        (F.count_if(open_) - 1).alias("current_index"),
        F.max_by("seq", F.when(open_, order)).alias("current_seq"),
        F.min_by("seq", F.when(past, order)).alias("next_seq"),
        F.max_by("seq", F.when(F.col("seq") < ph, order)).alias("prev_seq"),
    )
