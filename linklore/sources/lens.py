"""Read the star-schema + event tables as recordings.

Fifteen users make one session, so a session keeps about a thousand events at
every scale and the number of sessions grows with the data.  One second of the
operators is one hour of table time.  Each event type becomes one variant; the
access points of a scan are the line items of one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..params import Params
from ..plans.sequence import Layout, choose_layout, running, scan, spread
from .recording import BASE, Recording

HOUR_US = 3_600_000_000
USERS_PER_SESSION = 15
LENS_PARAMS = Params(second_us=HOUR_US)

# Fixed values of the lens.
CHANNELS = (1, 6, 11, 36, 149)
COUNTER_SCALE = (500, 5_000, 50_000, 1_000_000)
STATES = ("Operational", "Stale", "HardwareDisabled")

_layouts: dict[tuple[str, str], Layout] = {}


def epoch_us(ts: Column) -> Column:
    """Microseconds of a zone-free timestamp, whatever the session time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def events(raw: DataFrame, event_type: str | None = None) -> DataFrame:
    """The event table as session rows; a type filter reaches the scan."""
    df = raw
    if event_type:
        df = df.where(F.col("event_type") == event_type)
    return df.select(
        F.floor(F.col("user_id") / USERS_PER_SESSION).cast("bigint").alias("session_id"),
        F.col("event_id").cast("bigint").alias("seq"),
        epoch_us(F.col("ts")).alias("at_us"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.dayofmonth("ts").alias("day"),
    )


def layout_of(raw: DataFrame, sf_dir: str) -> Layout:
    """Session layout, measured once per application and folder."""
    key = (raw.sparkSession.sparkContext.applicationId, sf_dir)
    if key not in _layouts:
        _layouts[key] = choose_layout(events(raw))
    return _layouts[key]


def _pick(values: tuple, index: Column, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index.cast("int"))


def _channel_band(number: Column, unknown: Column) -> Column:
    return F.when(unknown, "Unknown").otherwise(L.band_from_channel(number))


def gateway(df: DataFrame) -> DataFrame:
    nanos = F.round(F.col("value") * 1_000_000).cast("bigint")
    return df.select(
        *BASE,
        F.lit("gw0").alias("target"),
        nanos.alias("rtt_nanos"),
        L.nanos_to_ms(nanos).alias("rtt_ms"),
        (F.col("k") % 8 != 0).alias("reachable"),
        F.lit("icmp").alias("probe"),
    )


def dns(df: DataFrame) -> DataFrame:
    nanos = F.round(F.col("value") * 4_000_000).cast("bigint")
    answered = F.col("k") % 4 != 0
    return df.select(
        *BASE,
        F.lit("system").alias("resolver"),
        F.concat(F.lit("q"), (F.col("k") % 3).cast("string")).alias("query"),
        nanos.alias("rtt_nanos"),
        L.nanos_to_ms(nanos).alias("rtt_ms"),
        answered.alias("answered"),
        F.when(~answered, "timeout").alias("error"),
    )


def wifi(df: DataFrame) -> DataFrame:
    k = F.col("k")
    number = _pick(CHANNELS, k % 5, "int")
    home = F.concat(F.lit("b"), (F.floor(F.col("day") / 6) % 4).cast("string"))
    bssid = F.when(k == 1, "b9").when(k != 0, home)
    return df.select(
        *BASE,
        F.lit("en0").alias("interface"),
        F.concat(F.lit("s"), F.floor(F.col("day") / 16).cast("string")).alias("ssid"),
        bssid.alias("bssid"),
        (-30 - F.col("value").cast("int") % 60).alias("rssi_dbm"),
        F.lit(-95).alias("noise_dbm"),
        F.lit(None).cast("float").alias("tx_rate_mbps"),
        number.alias("channel_number"),
        _channel_band(number, k % 10 == 2).alias("channel_band"),
        F.lit(None).cast("string").alias("channel_width"),
        F.lit("Wpa2").alias("security"),
        F.lit(None).cast("string").alias("phy_mode"),
        F.when(bssid.isNull(), "Inferred").otherwise("Direct").alias("confidence"),
    )


def counters(df: DataFrame, layout: Layout) -> DataFrame:
    """Cumulative totals: running sums that restart where ``k % 20 = 0``."""
    scale = _pick(COUNTER_SCALE, F.col("day") % 4, "bigint")
    df = df.select(
        *BASE,
        F.col("k").cast("bigint").alias("k"),
        (F.col("value").cast("bigint") * scale).alias("rx"),
    )
    df = scan(spread(df, layout), ["session_id"], layout, epoch=running((F.col("k") % 20 == 0).cast("int")))
    df = scan(
        df,
        ["session_id", "epoch"],
        layout,
        rx_bytes=running(F.col("rx")),
        tx_bytes=running(F.col("k") * 100),
        rx_errors=running(F.col("k") % 3),
        tx_errors=running(F.col("k") % 2),
    )
    none = F.lit(None).cast("bigint")
    return df.select(
        *BASE,
        F.lit("en0").alias("interface"),
        "rx_bytes",
        "tx_bytes",
        F.floor(F.col("rx_bytes") / 1000).cast("bigint").alias("rx_packets"),
        F.floor(F.col("tx_bytes") / 1000).cast("bigint").alias("tx_packets"),
        "rx_errors",
        "tx_errors",
        none.alias("rx_dropped"),
        none.alias("tx_dropped"),
        none.alias("retry_count"),
    )


def _sensor() -> Column:
    return F.when(F.col("k") % 6 == 0, "wifi").otherwise("iface")


def _state() -> Column:
    return _pick(STATES, F.floor(F.col("k") / 6) % 3, "string")


def _source() -> Column:
    variant = _variant()
    return (
        F.when(variant == "GatewayLatency", "gateway")
        .when(variant == "DnsLatency", "dns")
        .when(variant == "InterfaceCounters", "iface")
        .when(variant == "SensorHealth", _sensor())
        .otherwise("wifi")
    )


def health(df: DataFrame) -> DataFrame:
    k = F.col("k")
    return df.where(k % 3 == 0).select(
        *BASE,
        _sensor().alias("sensor"),
        _state().alias("state"),
        F.lit("lens").alias("backend"),
        F.lit(None).cast("string").alias("detail"),
    )


def _part() -> Column:
    return F.floor(F.col("seq") / 5).cast("bigint")


def neighbors(scans: DataFrame, lineitem: DataFrame, layout: Layout) -> DataFrame:
    """Scan ``n`` hears the line items of part ``n div 5``."""
    number = _pick(CHANNELS, F.col("l_suppkey") % 5, "int")
    items = lineitem.select(
        F.col("l_partkey").alias("part"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("item"),
        F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("bssid"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 2).cast("string")).alias("ssid"),
        (-40 - F.col("l_quantity").cast("int")).alias("rssi_dbm"),
        number.alias("channel_number"),
        _channel_band(number, F.col("l_linenumber") % 4 == 0).alias("channel_band"),
    )
    heard = scans.select(
        "session_id",
        F.col("seq").alias("scan_seq"),
        _part().alias("part"),
    )
    text = F.lit(None).cast("string")
    return spread(heard, layout, "part").join(spread(items, layout, "part"), "part").select(
        "session_id",
        "scan_seq",
        F.col("item").alias("pos"),
        "bssid",
        "ssid",
        "rssi_dbm",
        "channel_number",
        "channel_band",
        text.alias("channel_width"),
        text.alias("security"),
        text.alias("phy_mode"),
        F.lit("Direct").alias("confidence"),
    )


def neighbor_counts(scans: DataFrame, lineitem: DataFrame, layout: Layout) -> DataFrame:
    """How many rows :func:`neighbors` has for each scan, from the counts of both sides."""
    items = spread(lineitem.select(F.col("l_partkey").alias("part")), layout, "part")
    items = items.groupBy("part").agg(F.count(F.lit(1)).alias("items"))
    heard = scans.groupBy("session_id", "seq").agg(F.count(F.lit(1)).alias("copies"))
    heard = spread(heard.withColumn("part", _part()), layout, "part")
    return heard.join(items, "part").select(
        "session_id", "seq", (F.col("copies") * F.col("items")).alias("n_neighbors")
    )


def log_of(raw: DataFrame) -> DataFrame:
    """The payload-free log of an event table, batch or streaming."""
    return events(raw).select(
        *BASE,
        _variant().alias("event_type"),
        _source().alias("source"),
        F.when(_variant() == "SensorHealth", _state()).alias("health_state"),
    )


def recording(
    spark: SparkSession,
    sf_dir: str,
    layout: Layout | None = None,
    params: Params = LENS_PARAMS,
) -> Recording:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    layout = layout or layout_of(raw, sf_dir)

    def scan_rows() -> DataFrame:
        return events(raw, "signup").where(F.col("k") % 3 != 0).select(*BASE)

    def lineitem() -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def heard() -> DataFrame:
        return neighbors(scan_rows(), lineitem(), layout)

    def scans() -> DataFrame:
        sizes = neighbor_counts(scan_rows(), lineitem(), layout)
        return scan_rows().join(sizes, ["session_id", "seq"], "left").select(
            *BASE,
            F.lit("en0").alias("interface"),
            F.coalesce("n_neighbors", F.lit(0).cast("bigint")).alias("n_neighbors"),
        )

    streams = {
        "gateway": lambda: gateway(events(raw, "view")),
        "dns": lambda: dns(events(raw, "error")),
        "wifi": lambda: wifi(events(raw, "click")),
        "scans": scans,
        "counters": lambda: counters(events(raw, "purchase"), layout),
        "health": lambda: health(events(raw, "signup")),
        "log": lambda: log_of(raw),
    }
    return Recording(spark, streams, heard, layout, params, "bigint")


def _variant() -> Column:
    return (
        F.when(F.col("kind") == "view", "GatewayLatency")
        .when(F.col("kind") == "error", "DnsLatency")
        .when(F.col("kind") == "click", "Wifi")
        .when(F.col("kind") == "purchase", "InterfaceCounters")
        .when(F.col("k") % 3 == 0, "SensorHealth")
        .otherwise("Scan")
    )
