"""Session recordings: newline-delimited JSON, a header line and then one event
per line, in publication order.

All files of a folder are read in one pass, without a shuffle: the position of a
line is derived from the split it lies in, so order survives although Spark cuts
files.  ``land`` writes that pass to a columnar table pruned by variant; headers
and rejected lines are partitions of their own there, so checking them later
does not touch the events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..params import DEFAULTS, Params
from ..plans.sequence import WHOLE, Layout, position, scan
from .recording import BASE, ORIGIN, STREAMS, Recording

FORMAT_VERSION = 2
MIN_READABLE_VERSION = 2
DEFAULT_KIND = "network-session"

_CHANNEL = "struct<number:int,band:string,width:string>"
_NEIGHBOR = (
    f"struct<bssid:string,ssid:string,rssi_dbm:int,channel:{_CHANNEL},security:string,"
    "phy_mode:string,confidence:string>"
)
_RTT = "struct<secs:bigint,nanos:bigint>"

#: Superset of all variants; ``confidence`` and the two ``seen`` fields differ by
#: variant, so they stay text here and are cast per view.
EVENT = (
    "struct<type:string,interface:string,ssid:string,bssid:string,rssi_dbm:int,noise_dbm:int,"
    f"tx_rate_mbps:float,channel:{_CHANNEL},security:string,phy_mode:string,confidence:string,"
    f"neighbors:array<{_NEIGHBOR}>,target:string,rtt:{_RTT},reachable:boolean,probe:string,"
    "resolver:string,query:string,answered:boolean,error:string,previous:string,current:string,"
    "rx_bytes_total:bigint,tx_bytes_total:bigint,rx_packets_total:bigint,tx_packets_total:bigint,"
    "rx_errors_total:bigint,tx_errors_total:bigint,rx_dropped_total:bigint,tx_dropped_total:bigint,"
    "retry_count:bigint,from_bssid:string,to_bssid:string,from_rssi_dbm:int,to_rssi_dbm:int,"
    "kind:string,fingerprint:string,headline:string,peak_confidence:float,evidence:array<string>,"
    "lifecycle:string,first_seen:string,last_seen:string,sensor:string,state:string,"
    "backend:string,detail:string>"
)
ROW = f"row string, id bigint, at string, source string, event {EVENT}, _corrupt string"

# Fields a variant cannot do without.
REQUIRED = {
    "Wifi": ("interface", "confidence"),
    "Scan": ("interface", "neighbors"),
    "GatewayLatency": ("target", "rtt.secs", "rtt.nanos", "reachable", "probe"),
    "DnsLatency": ("resolver", "query", "rtt.secs", "rtt.nanos", "answered"),
    "InterfaceStateChanged": ("interface", "previous", "current"),
    "InterfaceCounters": (
        "interface", "rx_bytes_total", "tx_bytes_total", "rx_packets_total",
        "tx_packets_total", "rx_errors_total", "tx_errors_total",
    ),
    "RoamDetected": ("from_bssid", "to_bssid"),
    "Finding": (
        "kind", "fingerprint", "headline", "confidence", "peak_confidence", "evidence",
        "lifecycle", "first_seen", "last_seen",
    ),
    "SensorHealth": ("sensor", "state"),
}


class SessionError(ValueError):
    """A session file that cannot be read."""


# -- lines -----------------------------------------------------------------


def session_of(path: Column, by_folder: bool = False) -> Column:
    """Session of a file: its path (local ones are spelled in two ways), or the
    name of its folder."""
    if by_folder:
        return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)
    return F.regexp_replace(path, "^file:/+", "file:/")


#: Bits of ``seq`` for the position inside one file; the bits above number the
#: part files of a session written in parts.
_POSITION_BITS = 42
_ROW_BITS = (1 << 33) - 1


def read_lines(spark: SparkSession, path: str | list[str], by_folder: bool = False) -> DataFrame:
    """Lines with ``session_id`` (the file, or the folder of a session written in
    parts) and ``seq``, which grows along the session.

    ``seq`` is the split's byte offset plus the row's number in its task.  A task
    reads at most one split size of bytes and a line has at least one, so the
    number stays below the split size and the next split starts above it."""
    file = F.col("_metadata.file_path")
    position = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(
        F.lit(_ROW_BITS)
    )
    if by_folder:
        part = F.coalesce(
            F.expr(r"try_cast(regexp_extract(_metadata.file_path, 'part-([0-9]+)[^/]*$', 1) as bigint)"),
            F.lit(0),
        )
        position = F.shiftleft(part, _POSITION_BITS) + position
    return spark.read.text(path).select(
        session_of(file, by_folder).alias("session_id"), position.alias("seq"), "value"
    )


def _has_text(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("value") != "")


def parse_time(text: Column) -> Column:
    """Microseconds of an RFC 3339 text, or of the older 9-number form
    ``[year, day of year, h, m, s, ns, offset h, m, s]``."""
    digits = F.from_json(text, "array<bigint>")
    part = [F.get(digits, F.lit(i)) for i in range(9)]
    days = F.unix_date(F.make_date(part[0].cast("int"), F.lit(1), F.lit(1))) + part[1] - 1
    secs = (
        days * 86400 + part[2] * 3600 + part[3] * 60 + part[4]
        - part[6] * 3600 - part[7] * 60 - part[8]
    )
    tuple_us = secs * 1_000_000 + F.floor(part[5] / 1000)
    return F.when(text.startswith("["), tuple_us.cast("bigint")).otherwise(
        F.unix_micros(F.try_to_timestamp(text))
    )


# -- header ----------------------------------------------------------------


def _header_field(value: Column, name: str) -> Column:
    return F.get_json_object(value, f"$.{name}")


def _header_version(value: Column) -> Column:
    written = _header_field(value, "format_version")
    return F.when(written.rlike("^[0-9]+$"), written.try_cast("bigint"))


def header_status(value: Column, kind: str = DEFAULT_KIND) -> Column:
    """Verdict on the first line of a session.  The checks go from outside in, so that a
    wrong kind or version is reported as such even where the rest has another shape."""
    version = _header_version(value)
    shaped = (
        _header_field(value, "kind").isNotNull()
        & version.isNotNull()
        & F.unix_micros(F.try_to_timestamp(_header_field(value, "created_at"))).isNotNull()
        & _header_field(value, "tool_version").isNotNull()
    )
    return (
        # A landed event keeps no text: the first line was an event.
        F.when(value.isNull(), "MissingHeader")
        .when(F.try_parse_json(value).isNull(), "BadJson")
        .when(F.coalesce(_header_field(value, "row"), F.lit("")) != "header", "MissingHeader")
        .when(_header_field(value, "kind") != kind, "WrongKind")
        .when(version > FORMAT_VERSION, "NewerVersion")
        .when(version < MIN_READABLE_VERSION, "OlderVersion")
        .when(~shaped, "BadJson")
        .otherwise("ok")
    )


def headers(rows: DataFrame, kind: str = DEFAULT_KIND, files: DataFrame | None = None) -> DataFrame:
    """One row per session with its header fields and a ``status``, from the
    first line of each.  ``files`` adds sessions without any line.  ``others``
    counts the rows that are no complete events, the header among them."""
    df = rows.groupBy("session_id").agg(
        F.min(F.struct("seq", "value")).alias("f"),
        F.count_if(~F.col("is_good")).alias("others"),
    ).select("session_id", F.col("f.seq").alias("header_seq"), F.col("f.value").alias("value"), "others")
    if files is not None:
        df = files.join(df, "session_id", "left")

    field, version = _header_field, _header_version(F.col("value"))
    created = parse_time(field(F.col("value"), "created_at"))
    status = F.when(F.col("header_seq").isNull(), "Empty").otherwise(header_status(F.col("value"), kind))
    return df.select(
        "session_id",
        "header_seq",
        field(F.col("value"), "kind").alias("kind"),
        version.alias("format_version"),
        created.alias("created_us"),
        field(F.col("value"), "tool_version").alias("tool_version"),
        field(F.col("value"), "label").alias("label"),
        status.alias("status"),
        "others",
    )


# -- rows ------------------------------------------------------------------


def _is_good() -> Column:
    """Parsed, an envelope, a known variant, and complete."""
    complete = F
    for variant, fields in REQUIRED.items():
        present = F.lit(True)
        for name in fields:
            present = present & F.col(f"r.event.{name}").isNotNull()
        complete = complete.when(F.col("r.event.type") == variant, present)
    return (
        F.col("r").isNotNull()
        & F.col("r._corrupt").isNull()
        & (F.col("r.row") == "envelope")
        & F.col("r.id").isNotNull()
        & F.col("r.source").isNotNull()
        & F.col("at_us").isNotNull()
        & F.coalesce(complete.otherwise(False), F.lit(False))
    )


#: Unreadable sessions up to this many are sent to every task as a list.
_MAX_BROADCAST_SESSIONS = 100_000


@dataclass(frozen=True)
class SessionScan:
    """Parsed rows (header lines included) and the status of their sessions."""

    sessions: DataFrame
    rows: DataFrame
    lines: DataFrame | None = None

    def _readable(self, rows: DataFrame) -> DataFrame:
        unreadable = self.sessions.where("status <> 'ok'").select("session_id")
        n = unreadable.limit(_MAX_BROADCAST_SESSIONS + 1).count()
        if n == 0:
            return rows
        if n <= _MAX_BROADCAST_SESSIONS:
            unreadable = F.broadcast(unreadable)
        return rows.join(unreadable, "session_id", "left_anti")

    def good(self) -> DataFrame:
        """Every complete event of readable sessions."""
        return self._readable(self.rows.where("is_good"))

    def bad(self) -> DataFrame:
        """Rejected rows of readable sessions with the reason."""
        heads = self.sessions.where("status = 'ok'").select("session_id", "header_seq")
        header = F.coalesce(F.col("row_tag") == "header", F.lit(False))
        return (
            self.rows.where("not is_good")
            .join(heads, "session_id")
            .where(F.col("seq") > F.col("header_seq"))
            .select(
                "session_id", "header_seq", "seq",
                F.when(header, "DuplicateHeader").otherwise("BadJson").alias("error"), "value",
            )
        )

    def first_errors(self) -> DataFrame:
        """Per session the first rejected row, with its line number: the header
        is line 1 and blank lines after it count."""
        first = self.bad().groupBy("session_id").agg(
            F.min(F.struct("seq", "header_seq", "error")).alias("e")
        )
        upto = (F.col("seq") >= F.col("e.header_seq")) & (F.col("seq") <= F.col("e.seq"))
        return (
            self.lines.join(first, "session_id")
            .groupBy("session_id", F.col("e.error").alias("error"))
            .agg(F.count_if(upto).alias("line"))
        )

    def truncated(self) -> DataFrame:
        """Each session up to its first rejected row."""
        cut = self.bad().groupBy("session_id").agg(F.min("seq").alias("bad_seq"))
        return (
            self.good()
            .join(cut, "session_id", "left")
            .where(F.col("bad_seq").isNull() | (F.col("seq") < F.col("bad_seq")))
            .drop("bad_seq")
        )

    def strict(self) -> DataFrame:
        """All events.  An unreadable session or a rejected row is an error here,
        whatever variant is read later.  On a landed table the check reads the small
        folders of headers and rejected rows only."""
        # One pass tells both; only the header of a readable session is no event.
        amiss = self.sessions.where("status <> 'ok' or others > 1").limit(1).count()
        if not amiss:
            return self.rows.where("is_good")
        broken = self.sessions.where("status <> 'ok'").select("session_id", "status").first()
        if broken is not None:
            raise SessionError(f"{broken['session_id']}: {broken['status']}")
        wrong = self.bad().orderBy("session_id", "seq").first()
        if wrong is not None:
            where = f"{wrong['error']} in {wrong['session_id']}"
            if self.lines is not None:
                at = (F.col("session_id") == wrong["session_id"]) & (F.col("seq") >= wrong["header_seq"])
                where += f", line {self.lines.where(at & (F.col('seq') <= wrong['seq'])).count()}"
            raise SessionError(where)
        return self.rows.where("is_good")


def scan_sessions(
    spark: SparkSession,
    path: str | list[str],
    kind: str = DEFAULT_KIND,
    by_folder: bool = False,
) -> SessionScan:
    """Parse text files.  Every action reads the text; ``land`` it to read once."""
    lines = read_lines(spark, path, by_folder)
    rows = parsed(_has_text(lines))
    # Scans skip empty files, so the names come from the file index, which the
    # driver of any scan holds anyway.
    names = [(name,) for name in spark.read.text(path).inputFiles()]
    files = (
        spark.createDataFrame(names, "file string")
        .select(session_of(F.col("file"), by_folder).alias("session_id"))
        .distinct()
    )
    return SessionScan(headers(rows, kind, files), rows, lines)


def parsed(lines: DataFrame) -> DataFrame:
    """Envelope columns and the verdict on each line.  JSON is parsed once per
    line, for the fields that are asked for."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    df = lines.withColumn("r", F.from_json("value", ROW, options))
    df = df.withColumn("at_us", parse_time(F.col("r.at")))
    return df.select(
        *lines.columns,
        _is_good().alias("is_good"),
        F.col("r.row").alias("row_tag"),
        F.col("r.id").alias("id"),
        "at_us",
        F.col("r.at").alias("at_text"),
        F.col("r.source").alias("source"),
        F.col("r.event.type").alias("event_type"),
        F.col("r.event").alias("event"),
    )


def land(scan_: SessionScan, path: str) -> None:
    """Write parsed rows once, without a shuffle, partitioned by variant.
    Headers and rejected lines keep their text; events do not need it."""
    part = (
        F.when(F.col("is_good"), F.col("event_type"))
        .when(F.col("row_tag") == "header", "_header")
        .otherwise("_rejected")
    )
    (
        scan_.rows.withColumn("part", part)
        .withColumn("value", F.when(~F.col("is_good"), F.col("value")))
        .drop("is_good", "event_type")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy("part")
        .parquet(path)
    )


def read_landed(spark: SparkSession, path: str, kind: str = DEFAULT_KIND) -> SessionScan:
    """Rows written by :func:`land`.  A filter on the variant prunes folders."""
    event = ~F.col("part").startswith("_")
    rows = (
        spark.read.parquet(path)
        .withColumn("is_good", event)
        .withColumn("event_type", F.when(event, F.col("part")))
        .drop("part")
    )
    return SessionScan(headers(rows, kind), rows)


def read_sessions(
    spark: SparkSession,
    path: str | list[str],
    kind: str = DEFAULT_KIND,
    on_error: str = "fail",
    layout: Layout = WHOLE,
    params: Params = DEFAULTS,
    by_folder: bool = False,
    dedup: bool = False,
) -> Recording:
    """Recordings of all files: ``on_error`` is ``fail``, ``truncate`` or
    ``quarantine`` (keep every good row).  ``dedup`` removes equal copies of rows."""
    found = scan_sessions(spark, path, kind, by_folder)
    policies = {"fail": found.strict, "truncate": found.truncated, "quarantine": found.good}
    rows = policies[on_error]()
    return to_recording(deduplicate(rows) if dedup else rows, layout, params)


# -- envelopes -> typed streams --------------------------------------------


def to_recording(
    envelopes: DataFrame, layout: Layout = WHOLE, params: Params = DEFAULTS
) -> Recording:
    """Typed streams of envelopes (``session_id, seq, at_us, source, event``)."""
    e = F.col("event")

    def ms() -> Column:
        return L.duration_ms(e["rtt"]["secs"], e["rtt"]["nanos"])

    def nanos() -> Column:
        return e["rtt"]["secs"] * 1_000_000_000 + e["rtt"]["nanos"]

    special = {
        "rtt_nanos": nanos,
        "rtt_ms": ms,
        "channel_number": lambda: e["channel"]["number"],
        "channel_band": lambda: e["channel"]["band"],
        "channel_width": lambda: e["channel"]["width"],
        "bssid": lambda: L.canonical_bssid(e["bssid"]),
        "n_neighbors": lambda: F.size(e["neighbors"]).cast("bigint"),
        "first_seen_us": lambda: parse_time(e["first_seen"]),
        "last_seen_us": lambda: parse_time(e["last_seen"]),
        "retry_count": lambda: e["retry_count"],
    }
    origin = [c for c in ORIGIN if c in envelopes.columns]
    streams = {}
    for name, (variant, columns) in STREAMS.items():
        cols = list(origin)
        for column in columns.split(", "):
            field, kind = column.split(" ", 1)
            source = f"{field}_total" if field.startswith(("rx_", "tx_")) and name == "counters" else field
            value = special[field]() if field in special else e[source]
            cols.append(value.cast(kind).alias(field))
        streams[name] = envelopes.where(F.col("event_type") == variant).select(*BASE, *cols)
    streams["log"] = envelopes.select(
        *BASE, "event_type", "source",
        F.when(F.col("event_type") == "SensorHealth", e["state"]).alias("health_state"),
    )
    heard = envelopes.where(F.col("event_type") == "Scan").select(
        "session_id", F.col("seq").alias("scan_seq"), F.posexplode("event.neighbors").alias("pos", "ap")
    )
    ap = F.col("ap")
    neighbors = heard.select(
        "session_id",
        "scan_seq",
        "pos",
        L.canonical_bssid(ap["bssid"]).alias("bssid"),
        *[ap[c].alias(c) for c in ("ssid", "rssi_dbm")],
        *[ap["channel"][c].alias(f"channel_{c}") for c in ("number", "band", "width")],
        *[ap[c].alias(c) for c in ("security", "phy_mode", "confidence")],
    )
    return Recording(envelopes.sparkSession, streams, neighbors, layout, params)


def deduplicate(envelopes: DataFrame) -> DataFrame:
    """Of rows equal but for their place, the first in order.  Rows that share an
    id but differ in time or content all stay: ids restart with every recorder.
    The variant is in the key, so a filter on it still reaches the scan."""
    keys = ["session_id", "id", "event_type", "at_us", "_content"]
    content = [c for c in envelopes.columns if c not in (*keys, "seq", "at_text")]
    rest = [c for c in envelopes.columns if c not in keys]
    return (
        envelopes.withColumn("_content", F.xxhash64(*content))
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "seq").alias("_first"))
        .select(*keys, "_first.*")
        .drop("_content")
    )


def assign_ids(rows: DataFrame, layout: Layout = WHOLE) -> DataFrame:
    """Ids 1, 2, 3 ... per session for raw rows that have none."""
    return scan(rows, ["session_id"], layout, id=position())


# -- sink ------------------------------------------------------


def envelopes_of(rec: Recording) -> DataFrame:
    """Rebuild JSON rows of a recording: ``session_id, seq, value``."""
    streams = [n for n in rec.streams if n in STREAMS]
    out = None
    scans = None
    if "scans" in streams:
        ap = F.struct(
            "pos", "bssid", "ssid", "rssi_dbm", _channel_json().alias("channel"),
            "security", "phy_mode", "confidence",
        )
        heard = rec.neighbors.groupBy("session_id", F.col("scan_seq").alias("seq")).agg(
            F.transform(F.sort_array(F.collect_list(ap)), lambda x: x.dropFields("pos")).alias("neighbors")
        )
        scans = rec.scans.join(heard, ["session_id", "seq"], "left").withColumn(
            "neighbors", F.coalesce("neighbors", F.array().cast(f"array<{_NEIGHBOR}>"))
        )
    for name in streams:
        df = scans if name == "scans" else rec.stream(name)
        payload = [c for c in df.columns if c not in (*BASE, *ORIGIN, "n_neighbors")]
        for c in ORIGIN:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("bigint" if c == "id" else "string"))
        part = df.select(*BASE, _row(name, payload).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _channel_json() -> Column:
    return F.when(
        F.col("channel_number").isNotNull(),
        F.struct(
            F.col("channel_number").alias("number"),
            F.coalesce("channel_band", F.lit("Unknown")).alias("band"),
            F.col("channel_width").alias("width"),
        ),
    )


def _rfc3339(us: Column) -> Column:
    wall = F.to_utc_timestamp(F.timestamp_micros(us), F.current_timezone())
    return F.date_format(
        F.from_utc_timestamp(wall, F.lit("UTC")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    )


def _row(name: str, payload: list[str]) -> Column:
    variant = STREAMS[name][0]
    fields = [F.lit(variant).alias("type")]
    source = F.col("sensor") if name == "health" else None
    for c in payload:
        if c in ("rtt_ms", "channel_band", "channel_width"):
            continue
        if c == "rtt_nanos":
            fields.append(
                F.struct(
                    F.floor(F.col(c) / 1_000_000_000).cast("bigint").alias("secs"),
                    (F.col(c) % 1_000_000_000).alias("nanos"),
                ).alias("rtt")
            )
        elif c == "channel_number":
            fields.append(_channel_json().alias("channel"))
        elif c in ("first_seen_us", "last_seen_us"):
            fields.append(_rfc3339(F.col(c)).alias(c[:-3]))
        elif name == "counters" and c.startswith(("rx_", "tx_")):
            fields.append(F.col(c).alias(f"{c}_total"))
        else:
            fields.append(F.col(c))
    from .recording import SOURCE

    row = F.struct(
        F.lit("envelope").alias("row"),
        F.coalesce("id", "seq").alias("id"),
        F.coalesce("at_text", _rfc3339(F.col("at_us"))).alias("at"),
        F.coalesce("source", source if source is not None else F.lit(SOURCE[name])).alias("source"),
        F.struct(*fields).alias("event"),
    )
    return F.to_json(row)


def write_sessions(
    rows: DataFrame,
    path: str,
    kind: str = DEFAULT_KIND,
    tool_version: str = "1",
    created_us: int = 0,
    label: str | None = None,
    layout: Layout = WHOLE,
    headers: DataFrame | None = None,
) -> None:
    """One folder per session, header first, rows in order, older files replaced.
    ``headers`` (of ``SessionScan.sessions``) keeps the fields of the files read.

    A session that fits a task is one file.  Split layouts range-partition by
    position instead: a long session becomes several part files whose names
    follow the order of their rows (read back with ``by_folder``)."""
    if headers is None:
        known = rows.select("session_id").distinct()
        for c, kind_ in (("kind", "string"), ("tool_version", "string"), ("created_us", "bigint"), ("label", "string")):
            known = known.withColumn(c, F.lit(None).cast(kind_))
    else:
        known = headers.where("status = 'ok'")
    header = known.select(
        "session_id",
        F.lit(-1).cast("bigint").alias("seq"),
        F.to_json(
            F.struct(
                F.lit("header").alias("row"),
                F.coalesce("kind", F.lit(kind)).alias("kind"),
                F.lit(FORMAT_VERSION).alias("format_version"),
                _rfc3339(F.coalesce("created_us", F.lit(created_us).cast("bigint"))).alias("created_at"),
                F.coalesce("tool_version", F.lit(tool_version)).alias("tool_version"),
                F.coalesce("label", F.lit(label).cast("string")).alias("label"),
            )
        ).alias("value"),
    )
    rows = header.unionByName(rows.select("session_id", "seq", "value"))
    if layout.split:
        rows = rows.repartitionByRange("session_id", "seq")
    else:
        rows = rows.repartition("session_id")
    (
        rows.sortWithinPartitions("session_id", "seq")
        .select("session_id", "value")
        .write.mode("overwrite")
        .partitionBy("session_id")
        .text(path)
    )
