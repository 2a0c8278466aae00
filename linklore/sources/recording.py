"""A recording: one typed DataFrame per event variant.

Every stream has ``session_id``, ``seq`` (order inside the session), ``at_us``
(event time, microseconds) and the variant's own columns.  Scan neighbours live
in their own stream, one row each, so that no operator has to hold a scan as
one array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..params import DEFAULTS, Params
from ..plans.sequence import WHOLE, Layout, per_session

BASE = ["session_id", "seq", "at_us"]
#: What an envelope read from a file also carries, so that it can be written back.
ORIGIN = ["id", "source", "at_text"]

# Stream name, event variant, columns.
STREAMS: dict[str, tuple[str, str]] = {
    "gateway": (
        "GatewayLatency",
        "target string, rtt_nanos bigint, rtt_ms double, reachable boolean, probe string",
    ),
    "dns": (
        "DnsLatency",
        "resolver string, query string, rtt_nanos bigint, rtt_ms double, "
        "answered boolean, error string",
    ),
    "wifi": (
        "Wifi",
        "interface string, ssid string, bssid string, rssi_dbm int, noise_dbm int, "
        "tx_rate_mbps float, channel_number int, channel_band string, "
        "channel_width string, security string, phy_mode string, confidence string",
    ),
    "scans": ("Scan", "interface string, n_neighbors bigint"),
    "counters": (
        "InterfaceCounters",
        "interface string, rx_bytes bigint, tx_bytes bigint, rx_packets bigint, "
        "tx_packets bigint, rx_errors bigint, tx_errors bigint, rx_dropped bigint, "
        "tx_dropped bigint, retry_count bigint",
    ),
    "iface_states": (
        "InterfaceStateChanged",
        "interface string, previous string, current string",
    ),
    "roams": (
        "RoamDetected",
        "ssid string, from_bssid string, to_bssid string, from_rssi_dbm int, to_rssi_dbm int",
    ),
    "findings": (
        "Finding",
        "kind string, fingerprint string, headline string, confidence float, "
        "peak_confidence float, evidence array<string>, lifecycle string, "
        "first_seen_us bigint, last_seen_us bigint",
    ),
    "health": ("SensorHealth", "sensor string, state string, backend string, detail string"),
}
# The sensor that publishes each stream (health: the sensor itself).
SOURCE = {
    "gateway": "gateway",
    "dns": "dns",
    "wifi": "wifi",
    "scans": "wifi",
    "counters": "iface",
    "iface_states": "iface",
    "roams": "analysis",
    "findings": "analysis",
}
NEIGHBORS = (
    "scan_seq bigint, pos int, bssid string, ssid string, rssi_dbm int, "
    "channel_number int, channel_band string, channel_width string, "
    "security string, phy_mode string, confidence string"
)


@dataclass(frozen=True)
class Recording:
    """``streams`` and ``neighbor_rows`` hold DataFrames, or functions that
    build one when it is first asked for."""

    spark: SparkSession
    streams: dict[str, DataFrame | Callable[[], DataFrame]]
    neighbor_rows: DataFrame | Callable[[], DataFrame] | None = None
    layout: Layout = WHOLE
    params: Params = field(default=DEFAULTS)
    session_type: str = "string"

    def stream(self, name: str) -> DataFrame:
        if name in self.streams:
            if callable(self.streams[name]):
                self.streams[name] = self.streams[name]()
            return self.streams[name]
        return self._empty(STREAMS[name][1])

    def _empty(self, columns: str) -> DataFrame:
        base = f"session_id {self.session_type}, seq bigint, at_us bigint, "
        return self.spark.createDataFrame([], base + columns)

    gateway = property(lambda self: self.stream("gateway"))
    dns = property(lambda self: self.stream("dns"))
    wifi = property(lambda self: self.stream("wifi"))
    scans = property(lambda self: self.stream("scans"))
    counters = property(lambda self: self.stream("counters"))
    iface_states = property(lambda self: self.stream("iface_states"))
    roams = property(lambda self: self.stream("roams"))
    findings = property(lambda self: self.stream("findings"))
    health = property(lambda self: self.stream("health"))

    @property
    def neighbors(self) -> DataFrame:
        """One row per access point heard by a scan (``scan_seq``)."""
        if self.neighbor_rows is not None:
            return self.neighbor_rows() if callable(self.neighbor_rows) else self.neighbor_rows
        return self.spark.createDataFrame(
            [], f"session_id {self.session_type}, {NEIGHBORS}"
        )

    def log(self) -> DataFrame:
        """Every event without its payload: ``event_type``, ``source``, and
        ``health_state`` for sensor health."""
        if "log" in self.streams:
            return self.stream("log")
        parts = []
        for name in self.streams:
            df = self.stream(name)
            is_health = name == "health"
            source = F.col("sensor") if is_health else F.lit(SOURCE[name])
            parts.append(
                df.select(
                    *BASE,
                    F.lit(STREAMS[name][0]).alias("event_type"),
                    source.alias("source"),
                    (F.col("state") if is_health else F.lit(None).cast("string")).alias(
                        "health_state"
                    ),
                )
            )
        return reduce(DataFrame.unionByName, parts)

    def wifi_lost(self) -> DataFrame:
        return self.health.where((F.col("sensor") == "wifi") & F.col("state").isin(*L.WIFI_LOST))

    def iface_lost(self) -> DataFrame:
        return self.health.where(
            (F.col("sensor") == "iface") & F.col("state").isin(*L.IFACE_LOST)
        )

    def with_stream(self, name: str, df: DataFrame) -> Recording:
        return Recording(
            self.spark,
            {**self.streams, name: df},
            self.neighbor_rows,
            self.layout,
            self.params,
            self.session_type,
        )

    def seen_by(self, playhead: DataFrame) -> Recording:
        """Every stream without what no instant up to a playhead can see: ``playhead`` has one row
        per session with ``session_id`` and ``playhead_us``.

        Left out are the rows behind the playhead's time that also come, in the order of the log,
        after every row that is not behind it.  Windows in either order look backward, so what is
        derived for the instants up to the playhead stays the same; later instants are incomplete."""
        at, head = F.col("at_us"), F.col("playhead_us")
        last = (
            self.log()
            .join(playhead.select("session_id", "playhead_us"), "session_id")
            .groupBy("session_id", "playhead_us")
            .agg(F.max(F.when(at.isNull() | ~(at > head), F.col("seq"))).alias("last_seq"))
        )
        last = per_session(
            last.select(
                F.col("session_id").alias("_session"),
                F.col("playhead_us").alias("_head_us"),
                F.col("last_seq").alias("_last_seq"),
            )
        )

        def cut(df: DataFrame, seq: str, late: Column) -> DataFrame:
            kept = ~F.coalesce(late & (F.col(seq) > F.col("_last_seq")), F.lit(False))
            return df.join(last, (F.col("session_id") == F.col("_session")) & kept, "left_semi")

        after = F.col("at_us") > F.col("_head_us")
        return Recording(
            self.spark,
            {name: (lambda n=name: cut(self.stream(n), "seq", after)) for name in self.streams},
            None if self.neighbor_rows is None else (lambda: cut(self.neighbors, "scan_seq", F.lit(True))),
            self.layout,
            self.params,
            self.session_type,
        )

    def up_to(self, playhead: DataFrame) -> Recording:
        """Every stream cut at a playhead: ``playhead`` has one row per session
        with ``session_id`` and ``playhead_seq``."""

        def cut(df: DataFrame, col: str) -> DataFrame:
            return (
                df.join(playhead.select("session_id", "playhead_seq"), "session_id")
                .where(F.col(col) <= F.col("playhead_seq"))
                .drop("playhead_seq")
            )

        return Recording(
            self.spark,
            {name: (lambda n=name: cut(self.stream(n), "seq")) for name in self.streams},
            None if self.neighbor_rows is None else (lambda: cut(self.neighbors, "scan_seq")),
            self.layout,
            self.params,
            self.session_type,
        )
