"""Live tail of session files with Structured Streaming.

Files may still be growing: every completed line arrives once.  The header of a file is
checked with each of its rows; a row that is not an event of a readable session is kept with
the reason, for a sink of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.summary import COUNTERS, TALLIED
from ..params import DEFAULTS, Params
from ..sources.growing import growing_lines
from ..sources.session_files import DEFAULT_KIND, header_status, parsed


def tail_rows(spark: SparkSession, path: str, kind: str = DEFAULT_KIND) -> DataFrame:
    """Every row after the header, as it arrives, with ``error``: null for an event, else what is
    wrong with the file (a header status) or the row (``BadJson``, ``DuplicateHeader``)."""
    rows = parsed(growing_lines(spark, path).where(F.trim("value") != ""))
    status = header_status(F.col("header"), kind)
    again = F.coalesce(F.col("row_tag") == "header", F.lit(False))
    error = F.when(status != "ok", status).when(~F.col("is_good"), F.when(again, "DuplicateHeader").otherwise("BadJson"))
    # The first line of an unreadable file is a row like the others.
    rows = rows.withColumn("error", error).where((F.col("seq") > F.col("header_seq")) | (status != "ok"))
    return rows.drop("header", "header_seq")


def accepted(rows: DataFrame) -> DataFrame:
    """The envelopes among :func:`tail_rows`."""
    return rows.where("error is null").drop("error", "value")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("session_id", "seq", "error", "value")


def tail(
    spark: SparkSession, path: str, late: str = "10 minutes", kind: str = DEFAULT_KIND, dedup: bool = True
) -> DataFrame:
    """Envelopes as they arrive, watermarked by event time, in file order (``seq``).

    ``dedup`` removes copies that are equal in id, time and content (a recorder that starts
    late writes its backlog twice); rows that share an id only all stay.  It looks back ``late``
    in event time and drops what is older; see :func:`dropped_late`."""
    rows = accepted(tail_rows(spark, path, kind)).withColumn("at", F.timestamp_micros("at_us"))
    rows = rows.withWatermark("at", late)
    if not dedup:
        return rows
    content = F.xxhash64("source", "event_type", F.to_json("event"))
    keys = ["session_id", "id", "at_us", "_content"]
    return rows.withColumn("_content", content).dropDuplicatesWithinWatermark(keys).drop("_content")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark in the recent micro-batches of a query."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def land_tail(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write :func:`tail_rows` as they come: events by variant under ``events``, the others
    with their reason under ``rejected``.  A repeated batch replaces its folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, part, by in (("events", accepted(batch), ["event_type"]), ("rejected", rejected(batch), [])):
            part.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}/batch={batch_id:012d}")
        batch.unpersist()

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def land_stream(envelopes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append envelopes to a columnar table, one folder per variant."""
    return (
        envelopes.writeStream.format("parquet")
        .partitionBy("event_type")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def interval_counts(log: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Events per session, status interval and tallied variant of a watermarked
    log (``at`` timestamp).  Counting needs one row of state per open interval."""
    interval = F.window("at", f"{p.us(p.tally_every)} microseconds")
    names = {v: n for v, n in COUNTERS.items() if n in TALLIED}
    return log.groupBy("session_id", interval.alias("w")).agg(
        *[F.count_if(F.col("event_type") == v).alias(n) for v, n in names.items()]
    ).select("session_id", F.unix_micros("w.start").alias("window_us"), *names.values())


def upsert_to(path: str):
    """``foreachBatch`` sink: each batch's updated rows in a folder of its own.
    A repeated batch overwrites its folder, so retries do not double rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode(
            "overwrite"
        ).parquet(f"{path}/batch={batch_id:012d}")

    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key written by :func:`upsert_to`."""
    df = spark.read.parquet(path).drop("batch")
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
        .select(*keys, "r.*")
    )
