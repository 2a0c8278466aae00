"""Views for looking at a recording: strip, waterfall, rankings, cards, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..functions.text import byte_size, duration, fixed, let
from ..plans.sequence import last_known, scan
from ..sources.recording import BASE, Recording
from . import lifecycle
from . import windows as W
from .timeline import link_environment

SESSION = ["session_id"]

# Which severity wins a strip cell.
_SEVERITY_RANK = {"Notable": 1, "Recovery": 2, "Alarm": 3}


# -- playback axis ---------------------------------------------------------


def spans(rec: Recording) -> DataFrame:
    """First and last event time and the whole-second total per session."""
    ends = rec.log().groupBy(*SESSION).agg(
        F.min_by("at_us", "seq").alias("first_us"), F.max_by("at_us", "seq").alias("last_us")
    )
    total = L.active_duration(F.col("first_us"), F.col("last_us"), rec.params)
    return ends.withColumn("total_secs", total)


def half_way(rec: Recording) -> DataFrame:
    """A playhead in the middle of every session: its last event of the first
    half of the order range."""
    middle = F.floor((F.min("seq") + F.max("seq")) / 2).cast("bigint")
    target = rec.log().groupBy(*SESSION).agg(middle.alias("middle"))
    return (
        rec.log()
        .join(target, "session_id")
        .where(F.col("seq") <= F.col("middle"))
        .groupBy(*SESSION)
        .agg(F.max("seq").alias("playhead_seq"), F.max_by("at_us", "seq").alias("playhead_us"))
    )


def playback_position(rec: Recording, playheads: DataFrame, cols: int) -> DataFrame:
    """Elapsed and total whole seconds and the strip column of the playhead."""
    p = rec.params
    df = spans(rec).join(playheads, "session_id")
    offset = (F.col("playhead_us") - F.col("first_us")) / F.lit(float(p.second_us))
    return df.select(
        *SESSION,
        "playhead_seq",
        L.active_duration(F.col("first_us"), F.col("playhead_us"), p).alias("elapsed_secs"),
        "total_secs",
        strip_column(offset, F.col("total_secs"), cols).alias("col"),
    )


def strip_column(offset_secs: Column, total_secs: Column, cols: int) -> Column:
    """Column of an offset; null outside the recording or on an empty one."""
    if cols <= 0:
        return F.lit(None).cast("bigint")
    per_col = total_secs.cast("double") / F.lit(float(cols))
    col = F.least(F.floor(offset_secs / per_col).cast("bigint"), F.lit(cols - 1).cast("bigint"))
    return F.when((total_secs > 0) & (offset_secs >= 0), col)


def timeline_strip(rec: Recording, marks: DataFrame, cols: int) -> DataFrame:
    """Landmarks per fixed-width column with the worst severity."""
    p = rec.params
    axis = spans(rec).select(*SESSION, "first_us", "total_secs")
    offset = (F.col("at_us") - F.col("first_us")) / F.lit(float(p.second_us))
    rank = F.element_at(
        F.create_map(*[F.lit(x) for pair in _SEVERITY_RANK.items() for x in pair]),
        F.col("severity"),
    )
    hits = (
        marks.join(axis, "session_id")
        .withColumn("col", strip_column(offset, F.col("total_secs"), cols))
        .where(F.col("col").isNotNull())
        .groupBy(*SESSION, "col")
        .agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("worst"))
    )
    cells = axis.select(
        *SESSION, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint"))).alias("col")
    )
    names = F.array(*[F.lit(s) for s in _SEVERITY_RANK])
    return cells.join(hits, [*SESSION, "col"], "left").select(
        *SESSION,
        "col",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.get(names, F.col("worst") - 1).alias("worst_severity"),
        L.density_class(F.coalesce("n", F.lit(0))).alias("density"),
    )


# -- channels --------------------------------------------------------------


def _channel_key(band: Column, number: Column) -> Column:
    return F.struct(
        L.band_rank(L.settled_band(band, number)).alias("band_rank"), number.alias("number")
    )


def occupancy(rec: Recording) -> DataFrame:
    """Access points per scan and (band, channel); an unknown band is settled
    from the channel number first."""
    key = _channel_key(F.col("channel_band"), F.col("channel_number"))
    return (
        rec.neighbors.where(F.col("channel_number").isNotNull())
        .groupBy("session_id", "scan_seq", key.alias("key"))
        .agg(F.count(F.lit(1)).alias("ap_count"))
        .select("session_id", "scan_seq", "key.*", "ap_count")
    )


def scan_channels(rec: Recording) -> DataFrame:
    """Scans with the channel the link was on when each was taken."""
    link = F.when(
        F.col("channel_number").isNotNull(),
        _channel_key(F.col("channel_band"), F.col("channel_number")),
    )
    rows = rec.wifi.select(*BASE, F.lit(False).alias("is_scan"), F.struct(link.alias("key")).alias("on"))
    rows = rows.unionByName(
        rec.scans.select(*BASE, F.lit(True).alias("is_scan")), allowMissingColumns=True
    )
    df = scan(rows, SESSION, rec.layout, link=last_known(F.col("on")))
    return df.where("is_scan").select(*BASE, F.col("link.key").alias("connected"))


def waterfall(rec: Recording, max_rows: int, max_cols: int) -> DataFrame:
    """Channel by scan grid of the newest scans, one row per cell.

    Channels that do not fit ``max_rows`` are summed in one *other* row.  Kept
    first: channels the link used, newest first; then the densest.  The grid is
    bounded by ``max_rows * max_cols`` cells per session."""
    max_cols = min(max_cols, rec.params.scan_history)
    recent = W.last_n(scan_channels(rec), max_cols)
    recent = recent.select(
        *SESSION,
        F.col("seq").alias("scan_seq"),
        "at_us",
        "connected",
        (F.row_number().over(Window.partitionBy(*SESSION).orderBy("seq")) - 1).alias("col"),
    )
    counts = occupancy(rec).join(
        recent.select(*SESSION, "scan_seq", "col"), [*SESSION, "scan_seq"]
    )
    heard = counts.select(
        *SESSION,
        "col",
        F.struct("band_rank", "number").alias("key"),
        "ap_count",
        F.lit(False).alias("linked"),
    )
    linked = recent.where(F.col("connected").isNotNull()).select(
        *SESSION,
        "col",
        F.col("connected").alias("key"),
        F.lit(0).cast("bigint").alias("ap_count"),
        F.lit(True).alias("linked"),
    )
    points = heard.unionByName(linked)
    channels = points.groupBy(*SESSION, "key").agg(
        F.sum("ap_count").alias("total"), F.max(F.when(F.col("linked"), F.col("col"))).alias("last_linked")
    )
    per_session = Window.partitionBy(*SESSION)
    preference = per_session.orderBy(
        F.desc_nulls_last("last_linked"),
        F.when(F.col("last_linked").isNull(), F.col("total")).desc_nulls_last(),
        "key",
    )
    channels = channels.select(
        *SESSION,
        "key",
        F.row_number().over(preference).alias("place"),
        F.count(F.lit(1)).over(per_session).alias("n_channels"),
    ).withColumn(
        "kept",
        (F.col("n_channels") <= max_rows) | (F.col("place") <= max_rows - 1),
    )
    hidden = F.count_if(~F.col("kept")).over(per_session).alias("hidden_channels")
    row_key = F.when(F.col("kept"), F.col("key")).alias("row_key")
    channels = channels.select(*SESSION, "key", row_key, hidden)
    cells = (
        points.join(channels, [*SESSION, "key"])
        .groupBy(*SESSION, "row_key", "col")
        .agg(F.sum("ap_count").alias("ap_count"), F.bool_or("linked").alias("connected"))
    )
    rows = channels.select(*SESSION, "row_key", "hidden_channels").distinct()
    grid = rows.join(recent.select(*SESSION, "col", "scan_seq", "at_us"), "session_id")
    same_row = (
        (grid["session_id"] == cells["session_id"])
        & grid["row_key"].eqNullSafe(cells["row_key"])
        & (grid["col"] == cells["col"])
    )
    return grid.join(cells, same_row, "left").select(
        grid["session_id"],
        grid["row_key"].isNull().alias("is_other"),
        grid["row_key"]["band_rank"].alias("band_rank"),
        grid["row_key"]["number"].alias("number"),
        grid["col"].cast("bigint").alias("col"),
        "scan_seq",
        "at_us",
        F.coalesce(cells["ap_count"], F.lit(0).cast("bigint")).alias("ap_count"),
        F.coalesce(cells["connected"], F.lit(False)).alias("connected"),
        "hidden_channels",
    )


def latest(df: DataFrame, prefix: str = "") -> DataFrame:
    """Newest row per session, payload columns prefixed."""
    payload = [c for c in df.columns if c not in SESSION]
    return (
        df.groupBy(*SESSION)
        .agg(F.max_by(F.struct(*payload), F.col("seq")).alias("_row"))
        .select(*SESSION, *[F.col(f"_row.{c}").alias(f"{prefix}{c}") for c in payload])
    )


def latest_neighbors(rec: Recording) -> DataFrame:
    newest = latest(rec.scans).select(*SESSION, F.col("seq").alias("scan_seq"))
    return rec.neighbors.join(newest, [*SESSION, "scan_seq"])


def occupancy_ranking(rec: Recording) -> DataFrame:
    """Channels of the latest scan by how much they matter to the link: its own
    channel, busy ones of its band by distance, busy ones elsewhere, the rest."""
    link = latest(rec.wifi.select(*BASE, "channel_number", "channel_band"), "link_").select(
        *SESSION, "link_channel_number", "link_channel_band"
    )
    entries = (
        latest_neighbors(rec)
        .where(F.col("channel_number").isNotNull())
        .groupBy(*SESSION, "channel_number")
        .agg(
            F.count(F.lit(1)).alias("ap_count"),
            F.min_by("channel_band", "pos").alias("band"),
        )
        .join(link, "session_id", "left")
    )
    mine, n = F.col("link_channel_number"), F.col("channel_number")
    bucket = (
        F.when(mine == n, 0)
        .when(F.col("ap_count") <= 2, 3)
        .when(F.col("link_channel_band") == F.col("band"), 1)
        .otherwise(2)
    )
    distance = F.when(F.col("bucket") == 1, F.abs(n - mine)).otherwise(0)
    order = Window.partitionBy(*SESSION).orderBy(
        "bucket", "distance", F.desc("ap_count"), "channel_number"
    )
    return (
        entries.withColumn("bucket", bucket)
        .withColumn("distance", distance)
        .select(
            *SESSION,
            F.row_number().over(order).alias("place"),
            "channel_number",
            "band",
            "ap_count",
            "bucket",
        )
    )


def neighbor_table(rec: Recording, limit: int) -> DataFrame:
    """Strongest access points of the latest scan."""
    link = latest(rec.wifi.select(*BASE, "bssid"), "link_").select(*SESSION, "link_bssid")
    order = Window.partitionBy(*SESSION).orderBy(F.desc_nulls_last("rssi_dbm"), "pos")
    return (
        latest_neighbors(rec)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .join(link, "session_id", "left")
        .select(
            *SESSION,
            "place",
            "ssid",
            "bssid",
            "rssi_dbm",
            "channel_number",
            L.quality(L.rssi_goodness(F.col("rssi_dbm"))).alias("quality"),
            F.coalesce(F.col("bssid") == F.col("link_bssid"), F.lit(False)).alias("is_current"),
        )
    )


# -- findings --------------------------------------------------------------


def findings_ranking(active: DataFrame, limit: int, p) -> DataFrame:
    """Active findings by peak confidence, fingerprint breaking ties."""
    order = Window.partitionBy(*SESSION).orderBy(F.desc("peak_confidence"), "fingerprint")
    held = L.active_duration(F.col("first_seen_us"), F.col("last_seen_us"), p)
    return (
        active.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .select(
            *SESSION,
            "place",
            "fingerprint",
            "peak_confidence",
            "confidence",
            L.confidence_label(F.col("confidence")).alias("label"),
            duration(held).alias("active_for"),
        )
    )


def rf_summary(rec: Recording, active: DataFrame) -> DataFrame:
    """Connected channel, its pressure in the latest scan, and the density
    trend the active findings tell."""
    env = latest(link_environment(rec))
    trend = active.groupBy(*SESSION).agg(
        F.bool_or(F.col("fingerprint") == "rf_density_trend:rising").alias("rising"),
        F.bool_or(F.col("fingerprint") == "rf_density_trend:falling").alias("falling"),
    )
    number = F.col("link.channel_number")
    return env.join(trend, "session_id", "left").select(
        *SESSION,
        number.alias("channel_number"),
        F.when(number.isNotNull(), L.pressure_tier(F.col("channel_aps"))).alias("pressure"),
        F.when(F.coalesce("rising", F.lit(False)), "density rising")
        .when(F.coalesce("falling", F.lit(False)), "density falling")
        .otherwise("density stable")
        .alias("trend"),
    )


# -- cards -----------------------------------------------------------------


def _history(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The last ``n`` rows of every session as one array, oldest first."""
    return (
        W.last_n(df, n)
        .groupBy(*SESSION)
        .agg(F.sort_array(F.collect_list(F.struct("seq", "at_us", *cols))).alias("h"))
        .withColumn("last", F.element_at("h", -1))
    )


def _persistence(agreement: Column, p) -> Column:
    """Whole seconds for which the trailing rows have agreed with the last one;
    null under three.  ``agreement`` is an array of (at_us, same, seq)."""

    def held(rows: Column) -> Column:
        broke = F.array_max(F.transform(F.filter(rows, lambda x: ~x["same"]), lambda x: x["seq"]))
        return let(
            F.struct(rows.alias("rows"), broke.alias("broke")),
            lambda s: let(
                F.filter(
                    s["rows"], lambda x: s["broke"].isNull() | (x["seq"] > s["broke"])
                ),
                lambda run: L.active_duration(
                    F.element_at(run, 1)["at_us"], F.element_at(run, -1)["at_us"], p
                ),
            ),
        )

    return let(let(agreement, held), lambda secs: F.when(secs >= 3, secs))


def _agreement(cls) -> Column:
    return let(
        cls(F.element_at("h", -1)),
        lambda last: F.transform(
            "h",
            lambda x: F.struct(
                x["at_us"].alias("at_us"), (cls(x) == last).alias("same"), x["seq"].alias("seq")
            ),
        ),
    )


def _phrase(word: Column, secs: Column) -> Column:
    return F.when(secs.isNotNull(), F.concat(word, F.lit(" "), duration(secs)))


def _good(ok: str) -> Column:
    return F.sort_array(
        F.transform(F.filter("h", lambda x: x[ok]), lambda x: x["rtt_ms"])
    )


def _bad_percent(ok: str) -> Column:
    bad = F.size(F.filter("h", lambda x: ~x[ok]))
    return L.float32(L.float32(bad * 100.0) / F.size("h"))


def latency_card(rec: Recording) -> DataFrame:
    p = rec.params
    df = _history(rec.gateway, p.latency_history, "target", "rtt_ms", "reachable")
    df = df.withColumn("ordered", _good("reachable")).withColumn(
        "median_ms", F.coalesce(L.upper_median(F.col("ordered")), F.lit(0.0))
    )

    def stance(x: Column) -> Column:
        return L.gateway_stance(x["reachable"], x["rtt_ms"], F.col("median_ms"), p)

    secs = _persistence(_agreement(stance), p)
    last = F.col("last")
    return df.withColumn("held_secs", secs).select(
        *SESSION,
        last["target"].alias("target"),
        F.when(last["reachable"], F.concat(fixed(last["rtt_ms"], 1), F.lit(" ms")))
        .otherwise("unreachable")
        .alias("last"),
        "median_ms",
        F.coalesce(L.nearest_p95(F.col("ordered")), F.lit(0.0)).alias("p95_ms"),
        _bad_percent("reachable").alias("loss_pct"),
        L.quality(L.rtt_goodness(F.col("median_ms"), 5.0, 40.0)).alias("quality"),
        _phrase(stance(last), F.col("held_secs")).alias("stance"),
    )


def dns_card(rec: Recording) -> DataFrame:
    p = rec.params
    df = _history(rec.dns, p.latency_history, "resolver", "rtt_ms", "answered")
    df = df.withColumn(
        "median_ms", F.coalesce(L.upper_median(_good("answered")), F.lit(0.0))
    ).withColumn("fail_pct", _bad_percent("answered"))

    def stance(x: Column) -> Column:
        return L.dns_stance(x["answered"])

    last = F.col("last")
    share = L.float32(F.lit(1.0) - L.float32(F.col("fail_pct") / 100.0))
    good = F.least(L.rtt_goodness(F.col("median_ms"), 15.0, 150.0), share)
    return df.withColumn("held_secs", _persistence(_agreement(stance), p)).select(
        *SESSION,
        last["resolver"].alias("resolver"),
        F.when(last["answered"], F.concat(fixed(last["rtt_ms"], 0), F.lit(" ms")))
        .otherwise("FAIL")
        .alias("last"),
        "median_ms",
        "fail_pct",
        L.quality(good).alias("quality"),
        _phrase(stance(last), F.col("held_secs")).alias("stance"),
    )


def throughput_card(rec: Recording) -> DataFrame:
    """Rates of the newest counter row, and how long the activity regime has held.
    After a counter reset the newest row has no rate, while the history stays.  A
    lost interface clears both."""
    p = rec.params
    rated = W.throughput_window(rec)
    lost = rec.iface_lost().groupBy(*SESSION).agg(F.max("seq").alias("lost_seq"))
    rated = rated.join(lost, "session_id", "left").where(
        F.col("lost_seq").isNull() | (F.col("seq") > F.col("lost_seq"))
    )
    newest = rated.groupBy(*SESSION).agg(F.max_by(F.struct("rx_bps", "tx_bps"), "seq").alias("now"))
    df = _history(
        rated.where(F.col("step_rx_bps").isNotNull()), p.throughput_history, "rx_bps", "tx_bps", "step_rx_bps", "step_tx_bps"
    )

    def regime(x: Column) -> Column:
        return L.throughput_regime(x["step_rx_bps"], x["step_tx_bps"])

    last = F.col("last")
    word = F.when(regime(last) == "trickle", "trickling").otherwise(regime(last))
    return df.withColumn("held_secs", _persistence(_agreement(regime), p)).join(newest, SESSION).select(
        *SESSION,
        "now.rx_bps",
        "now.tx_bps",
        regime(last).alias("regime"),
        _phrase(word, F.col("held_secs")).alias("stance"),
    )


def link_card(rec: Recording) -> DataFrame:
    """Latest link, how long the association has held and how its signal moved,
    seen from the session's last event."""
    p = rec.params
    now = rec.log().groupBy(*SESSION).agg(F.max_by("at_us", "seq").alias("now_us"))
    link = latest(rec.wifi.select(*BASE, "ssid", "bssid", "rssi_dbm", "noise_dbm"))
    rows = W.association_epochs(rec)
    current = latest(rows).where(~F.col("lost")).select(*SESSION, "epoch", "since_us")
    readings = rows.where(F.col("rssi_dbm").isNotNull()).join(current.drop("since_us"), [*SESSION, "epoch"])
    half = p.card_lookback // 2
    age = F.col("now_us") - F.col("at_us")
    recent = age <= p.us(half)
    prior = ~recent & (age <= p.us(p.card_lookback))
    deltas = (
        W.last_n(readings, p.signal_history)
        .join(now, "session_id")
        .groupBy(*SESSION)
        .agg(
            F.sum(F.when(recent, F.col("rssi_dbm"))).alias("card_recent_sum"),
            F.count_if(recent).alias("card_recent_n"),
            F.sum(F.when(prior, F.col("rssi_dbm"))).alias("card_prior_sum"),
            F.count_if(prior).alias("card_prior_n"),
        )
        .select(*SESSION, W.half_delta("card").alias("delta"))
    )
    d = F.col("delta")
    drift = (
        F.when(d.isNull(), "\u2026")
        .when(F.abs(d) < 1.5, "stable")
        .otherwise(F.concat(fixed(d, 0, plus=True), F.lit(f" dB / {p.card_lookback}s")))
    )
    held = L.active_duration(F.col("since_us"), F.col("now_us"), p)
    return (
        link.join(now, "session_id")
        .join(current, "session_id", "left")
        .join(deltas, "session_id", "left")
        .select(
            *SESSION,
            "ssid",
            "bssid",
            "rssi_dbm",
            L.snr_db(F.col("rssi_dbm"), F.col("noise_dbm")).alias("snr_db"),
            L.quality(F.coalesce(L.rssi_goodness(F.col("rssi_dbm")), L.f32(0.5))).alias("quality"),
            F.when(F.col("since_us").isNotNull(), held).alias("held_secs"),
            F.when(F.col("since_us").isNotNull(), duration(held)).otherwise("\u2014").alias("held"),
            d.alias("delta"),
            drift.alias("drift"),
        )
    )


def latest_counters(rec: Recording) -> DataFrame:
    """Latest counter row and its total errors, unless the interface was lost
    after it."""
    lost = rec.iface_lost().groupBy(*SESSION).agg(F.max("seq").alias("lost_seq"))
    cols = ["interface", "rx_bytes", "tx_bytes", "rx_errors", "tx_errors"]
    return (
        latest(rec.counters.select(*BASE, *cols))
        .join(lost, "session_id", "left")
        .where(F.col("lost_seq").isNull() | (F.col("seq") > F.col("lost_seq")))
        .select(
            *SESSION,
            "seq",
            *cols,
            (F.col("rx_errors") + F.col("tx_errors")).alias("total_errors"),
        )
    )


def latest_health(rec: Recording) -> DataFrame:
    return (
        rec.health.groupBy(*SESSION, "sensor")
        .agg(F.max_by(F.struct("seq", "at_us", "state"), "seq").alias("h"))
        .select(*SESSION, "sensor", "h.*")
    )


# -- state as of a playhead ------------------------------------------------


def state_as_of(rec: Recording, playheads: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Everything the dashboard knows at a playhead, one row per session:
    a fresh computation over the events up to it.  ``findings`` may be those of the recording
    as the playheads see it (:meth:`Recording.seen_by`)."""
    past = rec.up_to(playheads)
    seen = past.log().groupBy(*SESSION).agg(F.count(F.lit(1)).alias("events"))
    parts = [
        link_card(past).select(
            *SESSION, "ssid", "bssid", "rssi_dbm", "held_secs", "delta"
        ),
        latest(past.scans.select(*BASE, "n_neighbors")).select(
            *SESSION, F.col("n_neighbors").alias("visible_aps")
        ),
        latency_card(past).select(*SESSION, F.col("median_ms").alias("gateway_ms"), "loss_pct"),
        dns_card(past).select(*SESSION, F.col("median_ms").alias("dns_ms"), "fail_pct"),
        latest_counters(past).select(*SESSION, "rx_bytes", "tx_bytes", "total_errors"),
        latest_health(past)
        .groupBy(*SESSION)
        .agg(F.count_if(F.col("state") != "Operational").alias("degraded_sensors")),
    ]
    if findings is not None:
        upto = findings.join(
            playheads.select(*SESSION, "playhead_us"), "session_id"
        ).where(F.col("at_us") <= F.col("playhead_us"))
        parts.append(
            lifecycle.active_findings(upto.drop("playhead_us"), rec.layout)
            .groupBy(*SESSION)
            .agg(F.count(F.lit(1)).alias("active_findings"))
        )
    for part in parts:
        seen = seen.join(part, "session_id", "left")
    return seen


# -- event feed ------------------------------------------------------------


def event_feed(rec: Recording) -> DataFrame:
    """One text line per event."""
    dash = F.lit("\u2014")

    def line(df: DataFrame, kind: str, *parts: Column | str) -> DataFrame:
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        return df.select(
            *BASE, L.category(F.lit(kind)).alias("category"), text.alias("line")
        )

    def dbm(col: str) -> Column:
        return F.coalesce(F.concat(F.col(col).cast("string"), F.lit(" dBm")), dash)

    gw_ok = F.concat(
        F.lit(" via "), "probe", F.lit(": "), fixed(F.col("rtt_ms"), 1), F.lit(" ms")
    )
    dns_ok = F.concat(
        F.lit(": "), fixed(F.col("rtt_ms"), 0), F.lit(" ms via "), "resolver"
    )
    dns_bad = F.concat(F.lit(" FAILED: "), F.coalesce("error", F.lit("")))
    made = {
        "wifi": lambda d: line(
            d, "Wifi", "wifi   ", F.coalesce("ssid", F.lit("<unassociated>")), " @ ", dbm("rssi_dbm")
        ),
        "scans": lambda d: line(
            d, "Scan", "scan   ", F.col("n_neighbors").cast("string"), " neighbor APs"
        ),
        "gateway": lambda d: line(
            d, "GatewayLatency", "gw     ", F.col("target"),
            F.when(F.col("reachable"), gw_ok).otherwise(" unreachable"),
        ),
        "dns": lambda d: line(
            d, "DnsLatency", "dns    ", F.col("query"), F.when(F.col("answered"), dns_ok).otherwise(dns_bad)
        ),
        "iface_states": lambda d: line(
            d, "InterfaceStateChanged", "iface  ", F.col("interface"), " ", F.col("previous"),
            "\u2192", F.col("current"),
        ),
        "counters": lambda d: line(
            d, "InterfaceCounters", "iface  ", F.col("interface"),
            " rx=", byte_size(F.col("rx_bytes")), " tx=", byte_size(F.col("tx_bytes")),
            " err=", F.col("rx_errors").cast("string"), "/", F.col("tx_errors").cast("string"),
        ),
        "roams": lambda d: line(
            d, "RoamDetected", "roam   ", F.col("from_bssid"), " \u2192 ", F.col("to_bssid"),
            " (", dbm("from_rssi_dbm"), " \u2192 ", dbm("to_rssi_dbm"), ")",
        ),
        "findings": lambda d: line(
            d, "Finding", "find   ",
            F.when(F.col("lifecycle") == "Active", "\u25cf")
            .when(F.col("lifecycle") == "Escalating", "\u2191")
            .when(F.col("lifecycle") == "Recovering", "\u2193")
            .otherwise("\u25cb"),
            " [", F.col("kind"), " c=", fixed(F.col("confidence"), 2), "] ", F.col("headline"),
        ),
        "health": lambda d: line(
            d, "SensorHealth", "health ", F.col("sensor"), " \u2192 ", F.col("state"), " via ",
            F.coalesce("backend", dash),
            F.coalesce(F.concat(F.lit(" ("), "detail", F.lit(")")), F.lit("")),
        ),
    }
    out = None
    for name, make in made.items():
        if name in rec.streams:
            part = make(rec.stream(name))
            out = part if out is None else out.unionByName(part)
    return out


def recent_feed(rec: Recording) -> DataFrame:
    return W.last_n(event_feed(rec), rec.params.feed_history)


def backlog(rec: Recording, n: int | None = None) -> DataFrame:
    """The last ``n`` events of every session (default: the backlog size)."""
    return W.last_n(rec.log(), rec.params.backlog if n is None else n)
