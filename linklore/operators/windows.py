"""Rolling windows and bounded series.

A window is anchored at the sample that was just recorded: it keeps what is no
older than its span at that moment, and does not age until the next sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..plans.sequence import (
    Layout,
    frame_count,
    frame_earliest,
    frame_list,
    frame_sum,
    last_known,
    materialize,
    position,
    previous,
    running,
    scan,
    spread,
    trailing,
)
from ..plans.selection import frame_count_above, frame_value_at_rank
from ..sources.recording import BASE, Recording

SESSION = ["session_id"]


def _ratio(part: Column, whole: Column) -> Column:
    """Single-precision share; 0 when there is nothing to share."""
    return L.float32(F.when(whole > 0, part / whole).otherwise(0.0))


# -- latency ---------------------------------------------------------------


def gateway_window(rec: Recording) -> DataFrame:
    """Count, loss, upper median, nearest-rank p95 and elevated count over the
    latency span ending at every probe."""
    df = _latency_frames(rec, rec.gateway, "reachable", rec.params.elevated_multiple)
    return df.select(
        *BASE, "target", "n", _ratio(F.col("bad"), F.col("n")).alias("loss"),
        "median_ms", "p95_ms", "elevated",
    )


def dns_window(rec: Recording) -> DataFrame:
    df = _latency_frames(rec, rec.dns, "answered")
    return df.select(
        *BASE, "n", _ratio(F.col("bad"), F.col("n")).alias("fail"), "median_ms"
    )


def _latency_frames(
    rec: Recording, rows: DataFrame, ok_col: str, multiple: float | None = None
) -> DataFrame:
    """Frame size, failures and order statistics of the successful round trips."""
    p = rec.params
    span = p.us(p.latency_span)
    ok = F.col(ok_col)
    counts = {
        "n": frame_count(F.lit(1), span),
        "bad": frame_count(F.when(~ok, 1), span),
    }
    rows = spread(rows, rec.layout)
    if rec.layout.split:
        rows = materialize(rows)
        sized = materialize(trailing(rows, SESSION, rec.layout, **counts))
        if (sized.agg(F.max("n")).first()[0] or 0) > rec.layout.frame_rows:
            return _dense_statistics(rec, sized, ok_col, multiple)
    df = trailing(
        rows, SESSION, rec.layout, **counts, rtts=frame_list(F.when(ok, F.col("rtt_ms")), span)
    )
    df = df.withColumn("ordered", F.sort_array("rtts")).withColumn(
        "median_ms", L.upper_median(F.col("ordered"))
    )
    df = df.withColumn("p95_ms", L.nearest_p95(F.col("ordered")))
    if multiple is not None:
        limit = F.col("median_ms") * multiple
        above = F.size(F.filter("ordered", lambda x: x > limit))
        df = df.withColumn("elevated", F.coalesce(above, F.lit(0)).cast("bigint"))
    return df.drop("rtts", "ordered")


def _last_not_above(limit_ms: Column) -> Column:
    """The longest whole-nanosecond time that is not above ``limit_ms`` once it is written
    in milliseconds, so that counting by nanoseconds and by milliseconds agree."""
    near = F.round(limit_ms * 1_000_000).cast("bigint")
    fits = lambda n: L.nanos_to_ms(n) <= limit_ms
    return F.when(fits(near + 1), near + 1).when(fits(near), near).otherwise(near - 1)


def _dense_statistics(
    rec: Recording, sized: DataFrame, ok_col: str, multiple: float | None
) -> DataFrame:
    """The same columns without collecting frames (see ``plans.selection``)."""
    span = rec.params.us(rec.params.latency_span)
    key = [*SESSION, "at_us", "seq"]
    elements = materialize(
        sized.where(ok_col).select(*key, F.col("rtt_nanos").alias("value"))
    )
    top = elements.agg(F.max("value")).first()[0] or 0
    members = F.col("n") - F.col("bad")
    p95 = F.least(F.floor(members * F.lit(0.95)).cast("bigint"), members - 1)
    half = F.floor(members / 2).cast("bigint")
    asked = sized.where(members > 0).select(
        *key,
        F.explode(
            F.array(
                F.struct(F.lit("median").alias("name"), half.alias("rank")),
                F.struct(F.lit("p95").alias("name"), p95.alias("rank")),
            )
        ).alias("q"),
    ).select(*key, "q.*")
    values = frame_value_at_rank(elements, asked, SESSION, span, top, rec.layout)
    values = materialize(
        values.groupBy(*key).agg(
            F.max(F.when(F.col("name") == "median", F.col("value"))).alias("median"),
            F.max(F.when(F.col("name") == "p95", F.col("value"))).alias("p95"),
        )
    )
    df = sized.join(values, key, "left")
    if multiple is not None:
        limit = F.least(_last_not_above(L.nanos_to_ms(F.col("median")) * multiple), F.lit(top))
        asked = df.where(F.col("median").isNotNull()).select(
            *key, members.alias("n"), limit.alias("limit")
        )
        above = frame_count_above(elements, asked, SESSION, span, top, rec.layout)
        df = df.join(above, key, "left").withColumn(
            "elevated", F.coalesce("above", F.lit(0).cast("bigint"))
        ).drop("above")
    return (
        df.withColumn("median_ms", L.nanos_to_ms(F.col("median")))
        .withColumn("p95_ms", L.nanos_to_ms(F.col("p95")))
        .drop("median", "p95")
    )


# -- connected link --------------------------------------------------------


def association_epochs(rec: Recording) -> DataFrame:
    """Wi-Fi rows with ``epoch`` (a new one per identity, and after the radio
    was lost), ``since_us`` (first observation of the epoch) and the key that
    names the association.  Loss rows stay in as ``lost`` rows: they end an
    epoch and carry no link."""
    link = rec.wifi.select(
        *BASE, F.lit(False).alias("lost"), "ssid", "bssid", "rssi_dbm", "noise_dbm"
    )
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    gone = rec.wifi_lost().select(
        *BASE,
        F.lit(True).alias("lost"),
        text.alias("ssid"),
        text.alias("bssid"),
        number.alias("rssi_dbm"),
        number.alias("noise_dbm"),
    )
    df = scan(
        spread(link.unionByName(gone), rec.layout),
        SESSION,
        rec.layout,
        before=previous("lost", "ssid", "bssid"),
    )
    before = F.col("before")
    same = (
        before.isNotNull()
        & ~before["lost"]
        & ~F.col("lost")
        & before["ssid"].eqNullSafe(F.col("ssid"))
        & before["bssid"].eqNullSafe(F.col("bssid"))
    )
    df = scan(
        df.withColumn("starts", ~same).drop("before"),
        SESSION,
        rec.layout,
        epoch=running(F.col("starts").cast("int")),
        since_us=last_known(F.when(F.col("starts"), F.col("at_us"))),
    )
    return df.select(
        "*", F.coalesce("bssid", "ssid", F.lit("current")).alias("identity_key")
    ).drop("starts")


def signal_window(rec: Recording) -> DataFrame:
    """Per Wi-Fi row: association duration, retained RSSI samples, and the
    half-window RSSI change at that row for the rule and the card lookback."""
    p = rec.params
    df = association_epochs(rec).where(~F.col("lost"))
    df = trailing(
        df,
        [*SESSION, "epoch"],
        rec.layout,
        samples=frame_count(F.col("rssi_dbm"), p.us(p.trend_span)),
        **half_frames("rssi_dbm", p.us(p.signal_lookback), p, "rule"),
        **half_frames("rssi_dbm", p.us(p.card_lookback), p, "card"),
    )
    # Only a row with a reading evicts, so a row without one keeps the count.
    df = scan(
        df.withColumn("samples", F.when(F.col("rssi_dbm").isNotNull(), F.col("samples"))),
        [*SESSION, "epoch"],
        rec.layout,
        retained=last_known(F.col("samples")),
    ).withColumn("samples", F.coalesce("retained", F.lit(0).cast("bigint")))
    return df.select(
        *BASE,
        "ssid",
        "bssid",
        "rssi_dbm",
        "epoch",
        "identity_key",
        "since_us",
        L.active_duration(F.col("since_us"), F.col("at_us"), p).alias("associated_secs"),
        "samples",
        half_delta("rule").alias("rssi_delta"),
        half_delta("card").alias("card_delta"),
    )


def half_frames(value: str, lookback_us: int, p, name: str) -> dict:
    """Frames of the recent and the prior half of a lookback; the half is cut
    in whole seconds."""
    half = (lookback_us // p.second_us // 2) * p.second_us
    x = F.col(value)
    return {
        f"{name}_recent_sum": frame_sum(x, half),
        f"{name}_recent_n": frame_count(x, half),
        f"{name}_prior_sum": frame_sum(x, lookback_us, half),
        f"{name}_prior_n": frame_count(x, lookback_us, half),
    }


def half_delta(name: str) -> Column:
    """Mean of the recent half minus mean of the prior half; null under two
    samples in either."""
    rs, rn, ps, pn = (
        F.col(f"{name}_{c}") for c in ("recent_sum", "recent_n", "prior_sum", "prior_n")
    )
    return F.when((rn >= 2) & (pn >= 2), rs / rn - ps / pn)


# -- radio environment -----------------------------------------------------


def density_window(rec: Recording) -> DataFrame:
    p = rec.params
    df = trailing(
        spread(rec.scans, rec.layout),
        SESSION,
        rec.layout,
        samples=frame_count(F.lit(1), p.us(p.trend_span)),
        **half_frames("n_neighbors", p.us(p.density_lookback), p, "rule"),
    )
    return df.select(
        *BASE,
        F.col("n_neighbors").alias("ap_count"),
        "samples",
        half_delta("rule").alias("density_delta"),
    )


# -- throughput ------------------------------------------------------------

_COUNTS = ["rx_bytes", "tx_bytes", "rx_errors", "tx_errors"]


def counter_epochs(rec: Recording) -> DataFrame:
    """Counter rows with ``epoch``: restarts on another interface, on a byte
    total that fell, and after the interface was lost.  Loss rows stay in."""
    rows = rec.counters.select(*BASE, F.lit(False).alias("lost"), "interface", *_COUNTS)
    gone = rec.iface_lost().select(
        *BASE,
        F.lit(True).alias("lost"),
        F.lit(None).cast("string").alias("interface"),
        *[F.lit(None).cast("bigint").alias(c) for c in _COUNTS],
    )
    df = scan(
        spread(rows.unionByName(gone), rec.layout),
        SESSION,
        rec.layout,
        before=previous("lost", "interface", "rx_bytes", "tx_bytes"),
    )
    before = F.col("before")
    continues = (
        before.isNotNull()
        & ~before["lost"]
        & ~F.col("lost")
        & (before["interface"] == F.col("interface"))
        & (F.col("rx_bytes") >= before["rx_bytes"])
        & (F.col("tx_bytes") >= before["tx_bytes"])
    )
    return scan(
        df.withColumn("starts", ~F.coalesce(continues, F.lit(False))).drop("before"),
        SESSION,
        rec.layout,
        epoch=running(F.col("starts").cast("int")),
    ).drop("starts")


def throughput_window(rec: Recording) -> DataFrame:
    """Window rate, step rate and window errors per counter row.  The window
    always keeps the last two samples of its epoch, however old."""
    p = rec.params
    df = counter_epochs(rec).where(~F.col("lost"))
    sample = ["at_us", "seq", *_COUNTS]
    df = scan(df, [*SESSION, "epoch"], rec.layout, prev=previous(*sample))
    df = trailing(
        df,
        [*SESSION, "epoch"],
        rec.layout,
        oldest=frame_earliest(F.struct(*sample), p.us(p.throughput_span)),
    )
    df = df.withColumn("first", F.coalesce("oldest", "prev"))
    first, prev = F.col("first"), F.col("prev")

    def secs(since: Column) -> Column:
        return (F.col("at_us") - since["at_us"]) / F.lit(float(p.second_us))

    def bps(col: str, since: Column) -> Column:
        return (F.col(col) - since[col]) / secs(since) * 8.0

    def grown(col: str) -> Column:
        none = F.lit(0).cast("bigint")
        return F.coalesce(F.greatest(none, F.col(col) - first[col]), none)

    wide, stepped = secs(first) >= 1.0, secs(prev) > 0
    return df.select(
        *BASE,
        "interface",
        "epoch",
        F.when(wide, bps("rx_bytes", first)).alias("rx_bps"),
        F.when(wide, bps("tx_bytes", first)).alias("tx_bps"),
        F.when(wide, secs(first).cast("bigint")).alias("span_secs"),
        F.when(stepped, bps("rx_bytes", prev)).alias("step_rx_bps"),
        F.when(stepped, bps("tx_bytes", prev)).alias("step_tx_bps"),
        (grown("rx_errors") + grown("tx_errors")).alias("errors"),
    )


def link_idle(rx_bps: Column, tx_bps: Column, floor_bps: float) -> Column:
    return F.coalesce(F.greatest(rx_bps, tx_bps) < floor_bps, F.lit(True))


# -- bounded series --------------------------------------------------------


#: Up to this rank Spark limits every group before the exchange by itself.
_GROUP_LIMIT = 1000
_SALTS = 64


def last_n(df: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows per session.  Only candidates reach the task that
    ranks a session: Spark cuts small bounds map-side, larger ones are cut per
    salted part of the session first."""
    keys = keys or SESSION
    if n > _GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(_SALTS)))
        df = _newest(salted, n, [*keys, "_salt"]).drop("_salt")
    return _newest(df, n, keys)


def _newest(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return (
        df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
    )


def series_stats(df: DataFrame, value: str, n: int, lookback: int, p) -> DataFrame:
    """Summary of the last ``n`` samples: span, ends, max, and the mean over a
    lookback from the newest sample."""
    kept = last_n(df, n)
    ends = kept.groupBy(*SESSION).agg(F.max("at_us").alias("now_us"))
    recent = F.col("at_us") >= F.col("now_us") - p.us(lookback)
    return (
        kept.join(ends, "session_id")
        .groupBy(*SESSION)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("at_us", "seq").alias("earliest_us"),
            F.max_by("at_us", "seq").alias("latest_us"),
            F.max(value).alias("max_value"),
            F.avg(F.when(recent, F.col(value))).alias("mean_recent"),
        )
        .withColumn(
            "span_secs",
            F.when(
                F.col("n") >= 2,
                L.active_duration(F.col("earliest_us"), F.col("latest_us"), p),
            ),
        )
    )


def elapsed_since_last(df: DataFrame, now_us: DataFrame, p) -> DataFrame:
    """Whole seconds since the newest sample; ``now_us`` has one row per session."""
    last = df.groupBy(*SESSION).agg(F.max_by("at_us", "seq").alias("last_us"))
    return last.join(now_us, "session_id").select(
        *SESSION, L.active_duration(F.col("last_us"), F.col("now_us"), p).alias("elapsed_secs")
    )


def rolling_median(rec: Recording) -> DataFrame:
    """Upper median over the last probes, unreachable ones included."""
    return _last_probes(spread(rec.gateway, rec.layout), rec.params.median_probes, rec.layout)


def _last_probes(gateway: DataFrame, n: int, layout: Layout) -> DataFrame:
    """Frames of ``n`` rows.  A split session is cut by position, and each
    slice also receives the ``n - 1`` rows before it."""
    cols = gateway.columns
    part = list(SESSION)
    if layout.split:
        width = max(layout.segment_rows, n)
        df = scan(gateway, SESSION, layout, _pos=position())
        df = df.withColumn("_own", F.floor((F.col("_pos") - 1) / width).cast("bigint"))
        edge = (F.col("_pos") - 1) % width >= width - (n - 1)
        gateway = df.withColumn(
            "_slice",
            F.explode(
                F.when(edge, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))
            ),
        )
        part.append("_slice")
    frame = Window.partitionBy(*part).orderBy("seq").rowsBetween(-(n - 1), 0)
    out = gateway.withColumn(
        "median_ms", L.upper_median(F.sort_array(F.collect_list("rtt_ms").over(frame)))
    )
    if layout.split:
        out = out.where("_slice = _own")
    return out.select(*cols, "median_ms")


def step_rate(rec: Recording) -> DataFrame:
    """Landmark rate: consecutive counter rows, valid while time advances and
    neither total falls; interface and losses are ignored."""
    p = rec.params
    df = scan(
        spread(rec.counters.select(*BASE, "rx_bytes", "tx_bytes"), rec.layout),
        SESSION,
        rec.layout,
        prev=previous("at_us", "rx_bytes", "tx_bytes"),
    )
    prev = F.col("prev")
    secs = (F.col("at_us") - prev["at_us"]) / F.lit(float(p.second_us))
    valid = (
        (secs > 0)
        & (F.col("rx_bytes") >= prev["rx_bytes"])
        & (F.col("tx_bytes") >= prev["tx_bytes"])
    )

    def bps(col: str) -> Column:
        return (F.col(col) - prev[col]) / secs * 8.0

    rated = df.where(valid).select(
        *BASE, bps("rx_bytes").alias("rx_bps"), bps("tx_bytes").alias("tx_bps")
    )
    return rated.withColumn("regime", L.throughput_regime(F.col("rx_bps"), F.col("tx_bps")))
