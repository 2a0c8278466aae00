"""Named queries over the table lens: one per operator that yields a table.

Every entry takes ``(spark, sf_dir)`` and returns a flat DataFrame (floats
widened to double, arrays of text joined) so that results can be compared with
plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ladders as L
from ..functions import text as X
from ..operators import landmarks as M
from ..operators import lifecycle as C
from ..operators import projections as P
from ..operators import rules as R
from ..operators import summary as S
from ..operators import timeline as TL
from ..operators import windows as W
from ..functions import normalize as N
from ..session import keyed_state
from ..sources import lens, probes
from ..sources.recording import BASE, Recording
from ..sources.session_files import (
    assign_ids,
    deduplicate,
    envelopes_of,
    read_sessions,
    write_sessions,
)
from ..streaming import epochs as live_epochs
from ..streaming import findings as live_findings
from ..streaming import tail as stream
from ..streaming import windows as live
from .sequence import per_session, scratch_folder, tasks_for

Query = Callable[[SparkSession, str], DataFrame]

STRIP_COLS = 60
GRID_ROWS, GRID_COLS = 4, 12
TOP = 8
SHORT_SERIES = 30


def flat(df: DataFrame) -> DataFrame:
    """Scalars only: structs opened, floats widened, text arrays joined."""
    cols = []
    for f in df.schema:
        if isinstance(f.dataType, T.FloatType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(f.name, " | ").alias(f.name))
        elif isinstance(f.dataType, T.StructType):
            for g in f.dataType:
                cols.append(F.col(f.name)[g.name].alias(f"{f.name}_{g.name}"))
        elif isinstance(f.dataType, T.IntegerType):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    out = df.select(*cols)
    nested = (T.StructType, T.FloatType, T.ArrayType, T.IntegerType)
    return flat(out) if any(isinstance(f.dataType, nested) for f in out.schema) else out


def _timeline(rec: Recording) -> DataFrame:
    """The as-of frame, opened to one column per state field."""
    df = TL.timeline(rec)
    return df.select(
        "session_id",
        *TL.INSTANT,
        *[F.col(f"gw.{c}").alias(f"gw_{c}") for c in ("n", "loss", "median_ms", "p95_ms", "elevated")],
        *[F.col(f"dns.{c}").alias(f"dns_{c}") for c in ("n", "fail", "median_ms")],
        F.col("rf.link.ssid").alias("ssid"),
        F.col("rf.link.bssid").alias("bssid"),
        F.col("rf.link.rssi_dbm").alias("rssi_dbm"),
        F.col("rf.link.channel_number").alias("channel_number"),
        F.col("rf.heard.scan_seq").alias("scan_seq"),
        F.col("rf.channel_aps").alias("channel_aps"),
        F.col("rf.alternative.bssid").alias("alt_bssid"),
        F.col("rf.alternative.rssi_dbm").alias("alt_rssi"),
        F.col("sig.identity_key").alias("identity_key"),
        F.col("sig.since_us").alias("since_us"),
        F.col("sig.samples").alias("sig_samples"),
        F.col("env.ap_count").alias("ap_count"),
        F.col("env.samples").alias("env_samples"),
        F.col("tput.rx_bps").alias("rx_bps"),
        F.col("tput.tx_bps").alias("tx_bps"),
        "rssi_delta",
        "density_delta",
    )


def _rule(name: str) -> Callable[[Recording], DataFrame]:
    def run(rec: Recording) -> DataFrame:
        rule = {name: R.RULES[name]}
        return R.evaluate(TL.timeline(rec, R.needed(rule)), rec.params, rule)

    return run


def _last_active(rec: Recording) -> DataFrame:
    """Probes with whole seconds since the link was last seen active."""
    df = M.gateway_stances(rec)
    secs = L.whole_seconds(F.col("at_us") - F.col("active_us"), rec.params)
    return df.select(
        *BASE,
        "stance",
        secs.alias("idle_secs"),
        F.coalesce(secs >= rec.params.wakeup_idle, F.lit(True)).alias("link_was_idle"),
    )


def _link_neighbors(rec: Recording) -> DataFrame:
    return TL.link_environment(rec).select(
        *BASE,
        F.col("link.ssid").alias("ssid"),
        F.col("link.bssid").alias("bssid"),
        F.col("heard.scan_seq").alias("scan_seq"),
        "channel_aps",
        F.col("alternative.bssid").alias("alt_bssid"),
        F.col("alternative.rssi_dbm").alias("alt_rssi"),
    )


def _scan_link(rec: Recording) -> DataFrame:
    return P.scan_channels(rec).select(
        *BASE, F.col("connected.band_rank").alias("band_rank"), F.col("connected.number").alias("number")
    )


def _scan_pressure(rec: Recording) -> DataFrame:
    return TL.channel_counts(rec).withColumn("tier", L.pressure_tier(F.col("ap_count")))


def _link_ladders(rec: Recording) -> DataFrame:
    n, band = F.col("channel_number"), F.col("channel_band")
    return rec.wifi.select(
        *BASE,
        L.category(F.lit("Wifi")).alias("category"),
        L.canonical_bssid(F.upper("bssid")).alias("bssid"),
        L.band_from_channel(n).alias("band"),
        L.settled_band(band, n).alias("settled_band"),
        L.snr_db(F.col("rssi_dbm"), F.col("noise_dbm")).alias("snr_db"),
        L.rssi_goodness(F.col("rssi_dbm")).alias("goodness"),
        L.quality(L.rssi_goodness(F.col("rssi_dbm"))).alias("quality"),
    )


def _latency_ladders(rec: Recording) -> DataFrame:
    ms = F.col("rtt_ms")
    return rec.gateway.select(
        *BASE,
        ms.alias("rtt_ms"),
        L.clamp01(ms / 100.0).alias("clamped"),
        L.rtt_goodness(ms, 5.0, 40.0).alias("gateway_goodness"),
        L.rtt_goodness(ms, 15.0, 150.0).alias("dns_goodness"),
        L.quality(L.rtt_goodness(ms, 5.0, 40.0)).alias("quality"),
        L.confidence_label(L.float32(ms / 100.0)).alias("label"),
        L.gateway_stance(F.col("reachable"), ms, F.lit(20.0)).alias("stance"),
    )


def _number_text(rec: Recording) -> DataFrame:
    """All number renderings over counter totals and rates of every size."""
    rx = F.col("rx_bytes")
    x = rx.cast("double") / 1000.0
    return rec.counters.select(
        *BASE,
        X.rate(x).alias("rate"),
        X.rate(rx.cast("double") * 64.0).alias("fast_rate"),
        X.peak_rate(x).alias("peak"),
        X.byte_size(rx).alias("bytes"),
        X.duration(F.floor(x / 100)).alias("short_duration"),
        X.duration(F.floor(x / 100), hours_with_seconds=True).alias("long_duration"),
        X.fixed(x - 12345.675, 2, plus=True).alias("signed"),
    )


def _series(rec: Recording) -> DataFrame:
    return W.series_stats(rec.gateway, "rtt_ms", SHORT_SERIES, 30, rec.params)


def _elapsed(rec: Recording) -> DataFrame:
    now = P.spans(rec).select("session_id", F.col("last_us").alias("now_us"))
    return W.elapsed_since_last(rec.gateway, now, rec.params)


def _dedup(rec: Recording) -> DataFrame:
    """A recorder that started mid-stream writes its backlog twice."""
    twice = rec.log().unionByName(P.backlog(rec, 50))
    return deduplicate(twice.withColumn("id", F.col("seq"))).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum")
    )


def _assigned(rec: Recording) -> DataFrame:
    return assign_ids(rec.log(), rec.layout).select(*BASE, "id")


def _typed_counts(rec: Recording) -> DataFrame:
    """Every typed view, counted: the nine projections of the event union."""
    parts = None
    for name in ("gateway", "dns", "wifi", "scans", "counters", "health"):
        part = rec.stream(name).groupBy("session_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
        ).withColumn("view", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _playheads(rec: Recording) -> DataFrame:
    return P.half_way(rec)


def _landmarks(rec: Recording) -> DataFrame:
    """All families, with the derived findings put back on the log."""
    found = M.published(rec, C.findings(rec))
    return M.landmarks(rec.with_stream("findings", found))


def _strip(rec: Recording) -> DataFrame:
    return P.timeline_strip(rec, _landmarks(rec), STRIP_COLS)


def _around(rec: Recording) -> DataFrame:
    return M.around_playhead(_landmarks(rec), _playheads(rec), rec)


def _state(rec: Recording) -> DataFrame:
    heads = per_session(_playheads(rec))
    return P.state_as_of(rec, heads, C.findings(rec.seen_by(heads)))


def _active(rec: Recording) -> DataFrame:
    return C.active_findings(C.findings(rec), rec.layout)


def _epochs(rec: Recording) -> DataFrame:
    return W.association_epochs(rec).select(*BASE, "lost", "epoch", "since_us", "identity_key")


def _ping(rec: Recording) -> DataFrame:
    """Ping output rebuilt as text from the probes, then read back."""
    reply = F.concat(
        F.lit("64 bytes from 10.0.0.1: icmp_seq=1 ttl=64 time="),
        X.fixed(F.col("rtt_ms"), 2),
        F.lit(" ms"),
    )
    lines = rec.gateway.select(
        *BASE,
        "target",
        F.when(F.col("reachable"), reply).otherwise("Request timeout for icmp_seq 0").alias("text"),
    )
    return probes.ping_probes(lines, rec.params)


def _raw_channel(pos: Column) -> Column:
    number = F.col("channel_number").cast("string")
    return (
        F.when(pos % 4 == 0, F.concat(number, F.lit(" (5GHz, 80MHz)")))
        .when(pos % 4 == 1, F.concat(number, F.lit(",40")))
        .when(pos % 4 == 2, F.concat(number, F.lit(" (2GHz, 20MHz)")))
        .otherwise(number)
    )


def _raw_security(pos: Column) -> Column:
    words = [
        "spairport_security_mode_wpa3_transition", "spairport_security_mode_wpa3_personal",
        "pairport_security_mode_wpa2", "wpa", "WEP", "spairport_security_mode_none", "other",
    ]
    return F.get(F.array(*[F.lit(x) for x in words]), (pos % 7).cast("int"))


def _capture_text(rec: Recording) -> DataFrame:
    """Capture texts of every neighbour, normalised."""
    pos = F.col("pos")
    signal = F.concat(F.col("rssi_dbm").cast("string"), F.lit(" dBm / -9"), (pos % 10).cast("string"), F.lit(" dBm"))
    name = F.when(pos % 5 == 0, "<Redacted>").when(pos % 5 == 1, "").otherwise(F.col("ssid"))
    bssid = F.when(pos % 6 != 0, F.upper("bssid"))
    ch = N.channel(_raw_channel(pos))
    return rec.neighbors.select(
        "session_id",
        "scan_seq",
        "pos",
        N.ssid(name).alias("ssid"),
        L.canonical_bssid(bssid).alias("bssid"),
        N.signal_dbm(signal).alias("rssi_dbm"),
        N.noise_dbm(signal).alias("noise_dbm"),
        ch["number"].alias("channel_number"),
        ch["band"].alias("channel_band"),
        ch["width"].alias("channel_width"),
        N.security(_raw_security(pos)).alias("security"),
        N.observation_confidence(N.ssid(name), bssid).alias("confidence"),
    )


def _captures(rec: Recording) -> DataFrame:
    """One property list per Wi-Fi row: the link, and one neighbour."""

    def entry(key: str, value: Column) -> Column:
        return F.concat(
            F.lit(f"<key>{key}</key><string>"), value, F.lit("</string>")
        )

    signal = F.concat(F.col("rssi_dbm").cast("string"), F.lit(" dBm / -95 dBm"))
    net = F.concat(
        F.lit("<dict>"),
        entry("_name", F.col("ssid")),
        F.coalesce(entry("spairport_network_bssid", F.upper("bssid")), F.lit("")),
        entry("spairport_signal_noise", signal),
        entry("spairport_network_channel", _raw_channel(F.col("seq"))),
        F.lit("</dict>"),
    )
    xml = F.concat(
        F.lit('<?xml version="1.0"?><plist version="1.0"><array><dict><key>_dataType</key>'
              "<string>SPAirPortDataType</string><key>_items</key><array><dict>"
              "<key>spairport_airport_interfaces</key><array><dict><key>_name</key><string>en0</string>"
              "<key>spairport_current_network_information</key>"),
        net,
        F.lit("<key>spairport_airport_other_local_wireless_networks</key><array>"),
        net,
        F.lit("</array></dict></array></dict></array></dict></array></plist>"),
    )
    docs = rec.wifi.select(
        F.concat("session_id", F.lit("/"), "seq").alias("capture_id"),
        "at_us",
        xml.cast("binary").alias("content"),
    )
    parts = probes.capture_parts(docs)
    links = probes.capture_links(parts).withColumn("part", F.lit("link"))
    aps = probes.capture_neighbors(parts).withColumn("part", F.lit("neighbor"))
    cols = ["capture_id", "at_us", "part", "ssid", "bssid", "rssi_dbm", "channel_number",
            "channel_band", "channel_width", "confidence"]
    return links.select(*cols).unionByName(aps.select(*cols))


def _session_roundtrip(rec: Recording) -> DataFrame:
    """Write every session as JSON lines, read the files back, summarise."""
    path = scratch_folder(rec.spark, "sessions")
    write_sessions(envelopes_of(rec), path, layout=rec.layout)
    back = read_sessions(rec.spark, path, by_folder=True, layout=rec.layout, params=rec.params)
    out = S.session_summary(back).drop("duration_text")
    number = F.regexp_extract("session_id", "session_id=([0-9]+)", 1)
    return out.withColumn("session_id", number.cast("bigint"))


def _stream_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running tally, counted by a streaming query over the event table."""
    path = scratch_folder(spark, "tally")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    live = (
        spark.readStream.schema(raw.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    rec = lens.recording(spark, sf_dir)
    log = lens.log_of(live).withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "1 hour")
    query = (
        stream.interval_counts(log, rec.params)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/progress")
        .foreachBatch(stream.upsert_to(f"{path}/rows"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counted = stream.latest_rows(spark, f"{path}/rows", ["session_id", "window_us"])
    return flat(S.accumulate(counted))


FEED_SLICES, FEED_FILES = 4, 8


def _streamed(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame, Recording], DataFrame]
) -> DataFrame:
    """What ``build`` makes of a recording that arrives in several micro-batches: its events
    are written in slices of time, and a streaming query reads them as files come."""
    rec = lens.recording(spark, sf_dir)
    path = scratch_folder(spark, name)
    # Every slice and the heartbeats read the events, so they are derived once.
    live.window_events(rec).write.parquet(f"{path}/events")
    events = spark.read.parquet(f"{path}/events")
    tasks = tasks_for(spark, events.count())
    events = events.unionByName(live.heartbeats(events, rec.params))
    live.write_feed(events, f"{path}/feed", FEED_SLICES)
    feed = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FEED_FILES).parquet(f"{path}/feed")
    )
    with keyed_state(spark, tasks):
        query = (
            build(feed, rec)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start(f"{path}/rows")
        )
        query.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("session_id", F.col("session_id").cast(rec.session_type))


def _stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finding transitions of windows, rules and lifecycle kept as state of a stream."""
    return flat(_streamed(spark, sf_dir, "findings", lambda feed, rec: live_findings.finding_stream(feed, rec.params)))


def _stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association and counter epochs that a stream opens and closes."""
    return flat(_streamed(spark, sf_dir, "epochs", lambda feed, rec: live_epochs.epoch_stream(feed)))


OPERATORS: dict[str, Callable[[Recording], DataFrame]] = {
    # sources and ordering
    "event_index": S.event_index,
    "typed_views": _typed_counts,
    "deduplicate": _dedup,
    "assign_ids": _assigned,
    "backlog": lambda r: P.backlog(r, 100),
    "session_roundtrip": _session_roundtrip,
    "ping_ingest": _ping,
    "capture_text": _capture_text,
    "capture_ingest": _captures,
    # scalar functions
    "link_ladders": _link_ladders,
    "latency_ladders": _latency_ladders,
    "number_text": _number_text,
    "event_feed": P.event_feed,
    "recent_feed": P.recent_feed,
    # windows and series
    "gateway_window": W.gateway_window,
    "dns_window": W.dns_window,
    "association_epochs": _epochs,
    "signal_window": W.signal_window,
    "density_window": W.density_window,
    "counter_epochs": lambda r: W.counter_epochs(r).select(*BASE, "lost", "epoch"),
    "throughput_window": W.throughput_window,
    "rolling_median": lambda r: W.rolling_median(r).select(*BASE, "rtt_ms", "median_ms"),
    "step_rate": W.step_rate,
    "last_n": lambda r: W.last_n(r.gateway, SHORT_SERIES).select(*BASE, "rtt_ms"),
    "series_stats": _series,
    "elapsed_since_last": _elapsed,
    # point-in-time joins
    "evaluation_instants": TL.instants,
    "timeline": _timeline,
    "last_active": _last_active,
    "scan_link_channel": _scan_link,
    "link_neighbors": _link_neighbors,
    "landmarks_around_playhead": _around,
    # aggregations
    "session_summary": S.session_summary,
    "category_counts": S.category_counts,
    "running_tally": S.running_tally,
    "scan_pressure": _scan_pressure,
    "occupancy": P.occupancy,
    "coverage": S.coverage,
    "coverage_overall": S.coverage_overall,
    "coverage_time": S.coverage_time,
    "latency_card": P.latency_card,
    "dns_card": P.dns_card,
    "latest_counters": P.latest_counters,
    # rules and findings
    **{f"rule_{name}": _rule(name) for name in R.RULES},
    "roams": S.roams,
    "health_changes": M.health_changes,
    "findings": C.findings,
    "active_findings": _active,
    # landmarks
    "landmarks_findings": lambda r: M.from_findings(M.published(r, C.findings(r))),
    "landmarks_health": M.from_health,
    "landmarks_gateway": M.from_gateway,
    "landmarks_dns": M.from_dns,
    "landmarks_throughput": M.from_throughput,
    "landmarks": _landmarks,
    # projections
    "link_card": P.link_card,
    "throughput_card": P.throughput_card,
    "timeline_strip": _strip,
    "playback_position": lambda r: P.playback_position(r, _playheads(r), STRIP_COLS),
    "rf_waterfall": lambda r: P.waterfall(r, GRID_ROWS, GRID_COLS),
    "occupancy_ranking": P.occupancy_ranking,
    "neighbor_table": lambda r: P.neighbor_table(r, TOP),
    "findings_ranking": lambda r: P.findings_ranking(_active(r), TOP, r.params),
    "rf_summary": lambda r: P.rf_summary(r, _active(r)),
    "state_as_of": _state,
    "latest_health": P.latest_health,
}


def _on_lens(operator: Callable[[Recording], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(operator(lens.recording(spark, sf_dir)))

    return run


def queries() -> dict[str, Query]:
    return {
        **{name: _on_lens(op) for name, op in OPERATORS.items()},
        "stream_tally": _stream_tally,
        "stream_findings": _stream_findings,
        "stream_epochs": _stream_epochs,
    }
