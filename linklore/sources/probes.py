"""Raw probe output: ping text and Wi-Fi property-list captures."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..functions import normalize as N
from ..params import DEFAULTS, Params
from .recording import BASE

# Names used by the capture format.
_SECTION = "SPAirPortDataType"
_INTERFACES = "spairport_airport_interfaces"
_STATUS = "spairport_status_information"
_STATUS_OFF = "spairport_status_off"
_LINK = "spairport_current_network_information"
_OTHERS = "spairport_airport_other_local_wireless_networks"
_FIELDS = {
    "name": "_name",
    "bssid": "spairport_network_bssid",
    "signal": "spairport_signal_noise",
    "channel": "spairport_network_channel",
    "security": "spairport_security_mode",
    "phy_mode": "spairport_network_phymode",
}
_RATE = "spairport_network_rate"


# -- ping ------------------------------------------------------------------


def ping_probes(lines: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Gateway rows from ping output.  ``lines`` has the base columns plus
    ``target``, ``text`` and optionally ``succeeded`` (exit status).  Without a
    reply the round trip is the timeout."""
    ms = N.ping_ms(F.col("text"))
    ok = F.col("succeeded") if "succeeded" in lines.columns else F.lit(True)
    nanos = F.bround(F.coalesce(ms, F.lit(p.probe_timeout_ms)) * 1_000_000).cast("bigint")
    return lines.select(
        *BASE,
        "target",
        nanos.alias("rtt_nanos"),
        L.nanos_to_ms(nanos).alias("rtt_ms"),
        (ms.isNotNull() & ok).alias("reachable"),
        F.lit("icmp").alias("probe"),
    )


# -- captures --------------------------------------------------------------


def read_captures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Capture files as ``capture_id, at_us, content``."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("capture_id"),
        F.unix_micros("modificationTime").alias("at_us"),
        "content",
    )


#: One member of a dictionary of the document; a dictionary itself has no key.
_NODE = "struct<path:string,key:string,shape:string,text:string,number:double>"
#: Bytes of documents parsed before rows are handed on.
_BATCH_BYTES = 1 << 24


def _nodes(value, path: str = "") -> Iterator[tuple]:
    """Every dictionary of a document and its members, with the path of keys and places."""
    if isinstance(value, dict):
        yield path, None, "dict", None, None
        for key, v in value.items():
            number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
            yield path, key, type(v).__name__, v if isinstance(v, str) else None, number
            yield from _nodes(v, f"{path}/{key}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _nodes(v, f"{path}/{i}")


def capture_nodes(captures: DataFrame) -> DataFrame:
    """``capture_id, at_us, nodes, failure``: documents as flat lists.  Parsing the
    XML is the only Python here."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for capture_id, at_us, content in zip(pdf["capture_id"], pdf["at_us"], pdf["content"]):
                try:
                    found, failure = list(_nodes(plistlib.loads(bytes(content)))), None
                except Exception as e:  # any malformed document is one error row
                    found, failure = [], f"unreadable: {type(e).__name__}"
                rows.append((capture_id, at_us, found, failure))
                size += len(content)
                if size > _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["capture_id", "at_us", "nodes", "failure"]
    return captures.mapInPandas(parse, f"capture_id string, at_us bigint, nodes array<{_NODE}>, failure string")


def _where(test) -> Column:
    return F.filter("nodes", test)


def _first(nodes: Column, field: str) -> Column:
    return F.get(nodes, F.lit(0))[field]


def _member(path: Column, key: str, field: str) -> Column:
    """``field`` of a member of the dictionary at ``path``."""
    return _first(_where(lambda n: (n["path"] == path) & (n["key"] == key)), field)


def _entry(path: Column) -> list[Column]:
    size = F.size(_where(lambda n: (n["path"] == path) & n["key"].isNotNull()))
    texts = [_member(path, key, "text").alias(f) for f, key in _FIELDS.items()]
    return [size.alias("n_keys"), _member(path, _RATE, "number").cast("float").alias("rate"), *texts]


def capture_parts(captures: DataFrame, interface: str = "en0") -> DataFrame:
    """Raw texts of every capture: its link, its neighbours, or what went wrong."""
    df = capture_nodes(captures)
    marked = _where(lambda n: (n["key"] == "_dataType") & (n["text"] == _SECTION) & n["path"].rlike("^/[0-9]+$"))
    df = df.withColumn("section", F.coalesce(_first(marked, "path"), F.lit("/0")))
    place = F.concat(F.lit("^"), "section", F.lit(f"/_items/[0-9]+/{_INTERFACES}/[0-9]+$"))
    named = _where(lambda n: (n["key"] == "_name") & (n["text"] == interface) & F.call_function("rlike", n["path"], place))
    df = df.withColumn("iface", _first(named, "path"))
    df = df.withColumn("off", F.coalesce(F.lower(_member(F.col("iface"), _STATUS, "text")) == _STATUS_OFF, F.lit(False)))
    heard = F.concat(F.lit("^"), "iface", F.lit(f"/{_OTHERS}/[0-9]+$"))
    others = _where(lambda n: n["key"].isNull() & F.call_function("rlike", n["path"], heard))
    link = F.concat("iface", F.lit(f"/{_LINK}"))
    on = F.col("iface").isNotNull() & ~F.col("off")

    def part(name: str, path: Column | None = None, pos: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("part"), (pos if pos is not None else F.lit(None)).cast("int").alias("pos"),
                        (path if path is not None else none).alias("path"))

    listed = _member(F.col("iface"), _OTHERS, "shape") == "list"
    several = F.array_compact(
        F.array(
            F.when(F.col("iface").isNull(), part("error")),
            F.when(F.col("off"), part("off")),
            F.when(on, part("capture")),
            F.when(on & (_member(F.col("iface"), _LINK, "shape") == "dict"), part("link", link)),
            F.when(on & listed, part("scan")),
        )
    )
    near = F.when(on, F.transform(others, lambda n, i: part("neighbor", n["path"], i)))
    df = df.withColumn("piece", F.explode(F.concat(several, F.coalesce(near, F.array().cast("array<struct<part:string,pos:int,path:string>>")))))
    size, rate, name, *rest = _entry(F.col("piece.path"))
    wrong = F.when(F.col("piece.part") == "error", F.coalesce("failure", F.lit(f"interface {interface} not present")))
    filled = F.col("piece.path").isNotNull()
    return df.select(
        "capture_id", "at_us", "piece.part", "piece.pos",
        F.when(filled, size).alias("n_keys"), F.when(filled, rate).alias("rate"),
        F.coalesce(wrong, name).alias("name"), *rest,
    ).withColumn("interface", F.lit(interface))


def _normalized() -> dict[str, Column]:
    ch = N.channel(F.col("channel"))
    return {
        "ssid": N.ssid(F.col("name")),
        "bssid": L.canonical_bssid(F.col("bssid")),
        "rssi_dbm": N.signal_dbm(F.col("signal")),
        "channel_number": ch["number"],
        "channel_band": ch["band"],
        "channel_width": ch["width"],
        "security": N.security(F.col("security")),
        "phy_mode": F.col("phy_mode"),
    }


def capture_links(parts: DataFrame) -> DataFrame:
    """Connected link of each capture; an entry with a single key is noise."""
    n = _normalized()
    return parts.where((F.col("part") == "link") & (F.col("n_keys") >= 2)).select(
        "capture_id",
        "at_us",
        "interface",
        *[c.alias(k) for k, c in n.items()],
        N.noise_dbm(F.col("signal")).alias("noise_dbm"),
        F.col("rate").alias("tx_rate_mbps"),
        N.observation_confidence(n["ssid"], n["bssid"]).alias("confidence"),
    )


def capture_neighbors(parts: DataFrame) -> DataFrame:
    """Neighbours of each capture; an entry that says nothing is dropped."""
    n = _normalized()
    says = n["ssid"].isNotNull()
    for c in ("channel_number", "rssi_dbm", "bssid"):
        says = says | n[c].isNotNull()
    return parts.where((F.col("part") == "neighbor") & says).select(
        "capture_id",
        "at_us",
        "pos",
        *[c.alias(k) for k, c in n.items()],
        N.observation_confidence(n["ssid"], n["bssid"], n["rssi_dbm"]).alias("confidence"),
    )


def capture_scans(parts: DataFrame) -> DataFrame:
    """One row per capture that carries a neighbour list, empty or not."""
    sizes = capture_neighbors(parts).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_neighbors")
    )
    return (
        parts.where("part = 'scan'")
        .join(sizes, "capture_id", "left")
        .select(
            "capture_id", "at_us", "interface",
            F.coalesce("n_neighbors", F.lit(0).cast("bigint")).alias("n_neighbors"),
        )
    )


def capture_health(parts: DataFrame) -> DataFrame:
    """Sensor state told by each capture."""
    state = (
        F.when(F.col("part") == "off", "HardwareDisabled")
        .when(F.col("name").startswith("unreadable"), "ParseFailed")
        .when(F.col("part") == "error", "BackendUnavailable")
        .otherwise("Operational")
    )
    return parts.where(F.col("part").isin("off", "error", "capture")).select(
        "capture_id", "at_us", F.lit("wifi").alias("sensor"), state.alias("state"),
        F.when(F.col("part") == "error", F.col("name")).alias("detail"),
    )
