"""Live analysis: findings kept current while sessions are still being recorded.

Findings are a pure function of a session's events so far.  Each micro-batch is
appended to the landed table, and the sessions it touched are derived again with
the batch operators, so a live result equals a replayed one.  The work of a
batch is that of the touched sessions, not of the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import findings
from ..params import DEFAULTS, Params
from ..plans.sequence import WHOLE, Layout
from ..sources.session_files import deduplicate, to_recording

#: Touched sessions up to this many are sent to every task as a list.
_MAX_BROADCAST_SESSIONS = 100_000


def analyze_batches(
    events_path: str, findings_path: str, params: Params = DEFAULTS, layout: Layout = WHOLE
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for a stream of envelopes (``tail``).

    Both writes go to a folder named by the batch, so a repeated batch replaces
    what its first try wrote."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"batch={batch_id:012d}"
        batch.drop("at").write.mode("overwrite").parquet(f"{events_path}/{folder}")
        touched = spark.read.parquet(f"{events_path}/{folder}").select("session_id").distinct()
        if touched.limit(_MAX_BROADCAST_SESSIONS + 1).count() <= _MAX_BROADCAST_SESSIONS:
            touched = F.broadcast(touched)
        history = (
            spark.read.option("basePath", events_path)
            .parquet(events_path)
            .where(F.col("batch") <= batch_id)
            .drop("batch")
            .join(touched, "session_id", "left_semi")
        )
        found = findings(to_recording(deduplicate(history), layout, params))
        marked = touched.withColumn("analyzed", F.lit(True)).join(
            found.withColumn("found", F.lit(True)), "session_id", "left"
        )
        marked.drop("analyzed").write.mode("overwrite").parquet(f"{findings_path}/{folder}")

    return run


def current_findings(spark: SparkSession, findings_path: str) -> DataFrame:
    """Findings of every session as of the last batch that touched it."""
    rows = spark.read.option("basePath", findings_path).parquet(findings_path)
    newest = rows.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["session_id", "batch"]).where("found").drop("batch", "found")
