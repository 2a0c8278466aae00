"""Last-known state of every stream at every evaluation instant.

Spark has no as-of join.  The equivalent without any pairing of rows: put all
streams on one timeline and carry each stream's latest state forward.  That is
one exchange on the session and one sort, whatever the number of streams.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..params import Params
from ..plans.sequence import Layout, frame_count, frame_sum, last_known, scan, spread, trailing
from ..sources.recording import BASE, Recording
from . import windows as W

EVALUATED = ("GatewayLatency", "DnsLatency", "Scan", "Wifi")
INSTANT = ["at_us", "is_tick", "seq"]
CHANNEL = ["session_id", "scan_seq", "channel_number"]
NETWORK = ["session_id", "scan_seq", "ssid"]
_TICKS_PER_CHUNK = 4096
# Places in a scan below 2^43, signals within +-2^19 dBm.
_PLACE_BITS = 43


def slice_of(layout: Layout, at_us: str = "at_us") -> Column | None:
    """Segment of a merged timeline, for split layouts."""
    if not layout.split:
        return None
    return F.floor(F.col(at_us) / layout.segment_us).cast("bigint")


def quiet_span(p: Params) -> int:
    """Seconds after an event from which ticks repeat each other until the next event: no sample is
    left in a lookback that is measured at the tick itself, what stopped is resolved, and a change
    held back by the cooldown is out."""
    return max(p.signal_lookback, p.density_lookback) + max(p.resolved_after, p.cooldown) + 2 * p.tick


def ticks(rec: Recording, every: bool = True) -> DataFrame:
    """The evaluation timer: every tick from a session's first event until a
    finding last seen at its final event could resolve.  Generated in slots of bounded
    length, spread over tasks, so the ticks of a long session are never one array.

    Without ``every`` only slots with an event and their neighbours have ticks, so rows grow
    with the events and not with the time between them.  A slot is as long as
    :func:`quiet_span`: the ticks left out see what the tick before and the tick after them see."""
    p = rec.params
    step = p.us(p.tick)
    slot = _TICKS_PER_CHUNK * step if every else p.us(quiet_span(p))
    ends = rec.log().groupBy("session_id").agg(
        F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us")
    )
    count = F.floor((F.col("last_us") - F.col("first_us") + p.us(p.resolved_after)) / step) + 2
    ends = ends.select("session_id", "first_us", count.alias("n"))
    at = lambda us: F.floor(us / slot).cast("bigint")
    if every:
        final = F.col("first_us") + (F.col("n") - 1) * step
        slots = ends.select("*", F.explode(F.sequence(at(F.col("first_us")), at(final))).alias("slot"))
    else:
        here = at(F.col("at_us"))
        near = rec.log().select("session_id", F.explode(F.sequence(here - 1, here + 1)).alias("slot"))
        slots = near.distinct().join(ends, "session_id")
    if rec.layout.split:
        slots = slots.repartition("session_id", "slot")
    slots = spread(slots, rec.layout)
    place = lambda us: F.ceil((us - F.col("first_us")) / step).cast("bigint")
    begin = F.greatest(place(F.col("slot") * slot), F.lit(0).cast("bigint"))
    end = F.least(place((F.col("slot") + 1) * slot), F.col("n")) - 1
    return (
        slots.select("session_id", "first_us", begin.alias("begin"), end.alias("end"))
        .where("begin <= end")
        .select("session_id", "first_us", F.explode(F.sequence("begin", "end")).alias("seq"))
        .select("session_id", "seq", (F.col("first_us") + F.col("seq") * step).alias("at_us"))
    )


def instants(rec: Recording, every_tick: bool = True) -> DataFrame:
    """Every evaluation: one per gateway, DNS, scan or Wi-Fi event and tick."""
    at_events = rec.log().where(F.col("event_type").isin(*EVALUATED))
    return at_events.select("session_id", "at_us", F.lit(0).alias("is_tick"), "seq").unionByName(
        ticks(rec, every_tick).select("session_id", "at_us", F.lit(1).alias("is_tick"), "seq")
    )


def channel_counts(rec: Recording) -> DataFrame:
    """Access points per channel number of each scan."""
    known = rec.neighbors.where(F.col("channel_number").isNotNull())
    return (
        spread(known, rec.layout, *CHANNEL)
        .groupBy(*CHANNEL)
        .agg(F.count(F.lit(1)).alias("ap_count"))
    )


def same_ssid_best(rec: Recording) -> DataFrame:
    """Per scan and SSID the strongest access point, and the strongest one with
    another BSSID than that; the earlier entry wins ties."""
    known = rec.neighbors.where(
        F.col("ssid").isNotNull() & F.col("bssid").isNotNull() & F.col("rssi_dbm").isNotNull()
    )
    # One whole number orders by signal and then by place in the scan, so the
    # grouping stays a hash aggregate (a struct maximum would sort every row).
    strength = F.shiftleft(F.col("rssi_dbm").cast("bigint"), _PLACE_BITS) - F.col("pos")
    per_ap = (
        spread(known, rec.layout, *NETWORK)
        .groupBy(*NETWORK, "bssid")
        .agg(F.max(strength).alias("strength"))
    )
    rank = F.row_number().over(Window.partitionBy(*NETWORK).orderBy(F.desc("strength")))
    rssi = F.shiftright(F.col("strength") + ((1 << _PLACE_BITS) - 1), _PLACE_BITS)
    ap = F.struct("bssid", rssi.cast("int").alias("rssi_dbm"))
    return (
        per_ap.withColumn("rank", rank)
        .where(F.col("rank") <= 2)
        .groupBy(*NETWORK)
        .agg(
            F.max(F.when(F.col("rank") == 1, ap)).alias("best"),
            F.max(F.when(F.col("rank") == 2, ap)).alias("runner_up"),
        )
    )


def link_environment(rec: Recording) -> DataFrame:
    """State after each Wi-Fi or scan event: the link, the latest scan, how
    many of its access points share the link's channel, and the strongest
    alternative of the link's SSID.  Survives a lost radio, as the link is
    never forgotten."""
    link = F.struct("ssid", "bssid", "rssi_dbm", "channel_number", "channel_band")
    heard = F.struct(F.col("seq").alias("scan_seq"), "n_neighbors")
    rows = rec.wifi.select(*BASE, link.alias("link_now")).unionByName(
        rec.scans.select(*BASE, heard.alias("scan_now")), allowMissingColumns=True
    )
    df = scan(
        spread(rows, rec.layout),
        ["session_id"],
        rec.layout,
        link=last_known(F.col("link_now")),
        heard=last_known(F.col("scan_now")),
    ).select(
        *BASE,
        F.col("scan_now").isNotNull().alias("is_scan"),
        "link",
        "heard",
        F.col("heard.scan_seq").alias("scan_seq"),
        F.col("link.channel_number").alias("channel_number"),
        F.col("link.ssid").alias("ssid"),
    )
    df = spread(df, rec.layout, *CHANNEL).join(channel_counts(rec), CHANNEL, "left")
    df = spread(df, rec.layout, *NETWORK).join(same_ssid_best(rec), NETWORK, "left")
    other = F.when(F.col("best.bssid") != F.col("link.bssid"), F.col("best")).otherwise(
        F.when(F.col("best").isNotNull(), F.col("runner_up"))
    )
    return df.select(
        *BASE,
        "is_scan",
        "link",
        "heard",
        F.coalesce("ap_count", F.lit(0).cast("bigint")).alias("channel_aps"),
        F.when(F.col("link.bssid").isNotNull(), other).alias("alternative"),
    )


STATES = ("gw", "dns", "rf", "sig", "env", "tput")


def timeline(rec: Recording, needs: Iterable[str] = STATES, every_tick: bool = True) -> DataFrame:
    """One row per evaluation instant with the state of all streams:
    ``gw``, ``dns``, ``rf``, ``sig``, ``env``, ``tput``, and the half-window
    changes of signal and density measured at the instant itself.

    ``needs`` limits the states that are derived, not the instants.  Without ``every_tick`` the
    ticks that repeat their neighbours are left out (:func:`ticks`)."""
    p = rec.params
    needs = [s for s in STATES if s in set(needs)]
    event = F.lit(0).alias("is_tick")

    def rows(df: DataFrame, acts: bool, *state: Column) -> DataFrame:
        return df.select(*BASE, event, F.lit(int(acts)).alias("evaluates"), *state)

    parts = [
        ticks(rec, every_tick).select(
            "session_id", "seq", "at_us", F.lit(1).alias("is_tick"), F.lit(1).alias("evaluates")
        )
    ]
    # Events whose state is not needed still are instants.
    idle = [t for t, s in zip(EVALUATED, ("gw", "dns", "rf", "rf")) if s not in needs]
    if idle:
        parts.append(rows(rec.log().where(F.col("event_type").isin(*idle)), True))
    if "gw" in needs:
        fields = F.struct("n", "loss", "median_ms", "p95_ms", "elevated", "target")
        parts.append(rows(W.gateway_window(rec), True, fields.alias("gw_now")))
    if "dns" in needs:
        fields = F.struct("n", "fail", "median_ms")
        parts.append(rows(W.dns_window(rec), True, fields.alias("dns_now")))
    if "rf" in needs:
        fields = F.struct("link", "heard", "channel_aps", "alternative")
        parts.append(rows(link_environment(rec), True, fields.alias("rf_now")))
    if "sig" in needs:
        fields = F.struct("epoch", "identity_key", "since_us", "samples")
        parts.append(
            rows(W.signal_window(rec), False, fields.alias("sig_now"), F.col("rssi_dbm").alias("rssi"))
        )
        nothing = F.struct(
            F.lit(None).cast("bigint").alias("epoch"),
            F.lit(None).cast("string").alias("identity_key"),
            F.lit(None).cast("bigint").alias("since_us"),
            F.lit(None).cast("bigint").alias("samples"),
        )
        parts.append(rows(rec.wifi_lost(), False, nothing.alias("sig_now")))
    if "env" in needs:
        fields = F.struct("ap_count", "samples")
        parts.append(
            rows(W.density_window(rec), False, fields.alias("env_now"), F.col("ap_count").alias("aps"))
        )
    if "tput" in needs:
        fields = F.struct("rx_bps", "tx_bps")
        parts.append(rows(W.throughput_window(rec), False, fields.alias("tput_now")))
        none = F.lit(None).cast("double")
        nothing = F.struct(none.alias("rx_bps"), none.alias("tx_bps"))
        parts.append(rows(rec.iface_lost(), False, nothing.alias("tput_now")))

    df = scan(
        spread(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), rec.layout),
        ["session_id"],
        rec.layout,
        [*INSTANT, "evaluates"],
        slice_of(rec.layout),
        **{name: last_known(F.col(f"{name}_now")) for name in needs},
    )
    peers = ["is_tick", "seq", "evaluates"]
    extra = []
    # The density frames go first: they find the rows in the order of the scan above.
    if "env" in needs:
        df = trailing(
            df,
            ["session_id"],
            rec.layout,
            peers,
            **W.half_frames("aps", p.us(p.density_lookback), p, "env"),
        )
    if "sig" in needs:
        df = trailing(
            df.withColumn("sig_epoch", F.col("sig.epoch")),
            ["session_id", "sig_epoch"],
            rec.layout,
            peers,
            **W.half_frames("rssi", p.us(p.signal_lookback), p, "sig"),
        )
        held = F.col("sig_epoch").isNotNull()
        extra.append(F.when(held, W.half_delta("sig")).alias("rssi_delta"))
    if "env" in needs:
        extra.append(W.half_delta("env").alias("density_delta"))
    return df.where("evaluates = 1").select("session_id", *INSTANT, *needs, *extra)
