"""Sequential state over a session, as Spark window work.

Almost every operator here is a *prefix* computation over one ordered log: the
previous row, a running sum, the last known value.  Expressed as
``Window.partitionBy(session)`` that is one exchange and one sort, which is the
best plan as long as a session fits a task.  A recording may also be very long
(a third of all rows in one session), so each prefix computation has a second
form that never puts a session into one task:

1. cut the log into segments of a bounded number of rows,
2. compute the prefix inside every segment (window over session + segment),
3. reduce each segment to one summary row and run the prefix over those,
4. join the summary of everything before a segment back to its rows.

``Layout`` picks the form.  Both give the same rows; tests compare them.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "_segment"


@dataclass(frozen=True)
class Layout:
    """How a session is laid out over tasks.

    ``segment_rows`` / ``segment_us`` None: a session is one window partition.
    Otherwise logs are cut every ``segment_rows`` positions of the order key,
    and merged timelines (which have no single order key) every ``segment_us``.
    """

    segment_rows: int | None = None
    segment_us: int | None = None
    #: Frames of a split session with more rows are never collected.
    frame_rows: int = 20_000
    #: How many tasks share the rows of a stream or timeline; None leaves it to the session's settings.
    tasks: int | None = None

    @property
    def split(self) -> bool:
        return self.segment_rows is not None


WHOLE = Layout()

#: A session above this many rows is cut into segments.
MAX_SESSION_ROWS = 1_000_000

#: Log rows a task is meant to hold.
ROWS_PER_TASK = 100_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many log rows: the cores at least, and more as the log grows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def choose_layout(log: DataFrame, max_rows: int = MAX_SESSION_ROWS) -> Layout:
    """Measure the largest session and decide.  One map-side combined
    aggregate over two columns; a single row reaches the driver."""
    per_session = log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("at_us") - F.min("at_us")).alias("extent"),
    )
    found = per_session.agg(F.max(F.struct("n", "extent")).alias("top"), F.sum("n").alias("rows")).first()
    top, rows = found["top"], found["rows"] or 0
    tasks = tasks_for(log.sparkSession, rows) if rows > ROWS_PER_TASK else None
    if top is None or top["n"] <= max_rows:
        return Layout(tasks=tasks)
    return Layout(max_rows, max(1, top["extent"] * max_rows // top["n"]), tasks=tasks)


@dataclass(frozen=True)
class _Spec:
    kind: str
    value: Column


def previous(*cols: str | Column) -> _Spec:
    """The row before this one, as a struct; null on the first row."""
    return _Spec("previous", F.struct(*cols))


def running(value: Column) -> _Spec:
    """Sum over all rows up to and including this one."""
    return _Spec("running", F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")))


def last_known(value: Column) -> _Spec:
    """The most recent non-null value, this row included."""
    return _Spec("last", value)


def running_max(value: Column) -> _Spec:
    return _Spec("max", value)


def running_min(value: Column) -> _Spec:
    return _Spec("min", value)


def position() -> _Spec:
    """1, 2, 3 ... in order."""
    return running(F.lit(1))


def spread(df: DataFrame, layout: Layout, *keys: str) -> DataFrame:
    """Whole sessions (or whole groups of ``keys``) over as many tasks as the log asks for.
    Adaptive execution joins small shuffle parts by their compressed size, and wide rows that
    repeat their neighbours compress so well that a task would get far more of them than its
    memory takes.  Two sides of a join spread by all its keys are not exchanged again."""
    if layout.split or layout.tasks is None:
        return df
    return df.repartition(layout.tasks, *(keys or ("session_id",)))


def scan(
    df: DataFrame,
    keys: list[str],
    layout: Layout,
    order: list[str] | None = None,
    segment: Column | None = None,
    **specs: _Spec,
) -> DataFrame:
    """Add one column per spec.  Rows are ordered by ``order`` inside ``keys``.

    ``segment`` must not decrease along ``order``; by default it is derived
    from ``seq``.
    """
    order = order or ["seq"]
    if not layout.split:
        return df.select("*", *_local(specs, keys, order))

    if segment is None:
        segment = F.floor(F.col("seq") / layout.segment_rows).cast("bigint")
    df = settle(df.withColumn(SEGMENT, segment), layout)
    local_keys = [*keys, SEGMENT]
    rows = df.select("*", *_local(specs, local_keys, order))

    rank = F.struct(*order)
    summaries = df.groupBy(*local_keys).agg(
        *[_summary(s, rank).alias(f"_sum_{n}") for n, s in specs.items()]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = summaries.select(
        *local_keys,
        *[_carry(s, n, before).alias(f"_carry_{n}") for n, s in specs.items()],
    )
    joined = rows.join(carries, local_keys, "left")
    return joined.select(
        *[c for c in df.columns if c != SEGMENT],
        *[_combine(s, n).alias(n) for n, s in specs.items()],
    )


def _local(specs: dict[str, _Spec], keys: list[str], order: list[str]) -> list[Column]:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for name, s in specs.items():
        if s.kind == "previous":
            col = F.lag(s.value).over(w)
        elif s.kind == "running":
            col = F.sum(s.value).over(upto)
        elif s.kind in ("max", "min"):
            col = _extreme(s.kind)(s.value).over(upto)
        else:
            col = F.last(s.value, ignorenulls=True).over(upto)
        out.append(col.alias(name))
    return out


def _summary(s: _Spec, rank: Column) -> Column:
    if s.kind == "previous":
        return F.max_by(s.value, rank)
    if s.kind == "running":
        return F.sum(s.value)
    if s.kind in ("max", "min"):
        return _extreme(s.kind)(s.value)
    return F.max_by(s.value, F.when(s.value.isNotNull(), rank))


def _carry(s: _Spec, name: str, before) -> Column:
    col = F.col(f"_sum_{name}")
    if s.kind == "running":
        return F.sum(col).over(before)
    if s.kind in ("max", "min"):
        return _extreme(s.kind)(col).over(before)
    return F.last(col, ignorenulls=True).over(before)


def _combine(s: _Spec, name: str) -> Column:
    if s.kind == "running":
        return F.col(name) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0).cast("bigint"))
    if s.kind in ("max", "min"):
        pick = F.greatest if s.kind == "max" else F.least
        return pick(F.col(name), F.col(f"_carry_{name}"))
    return F.coalesce(F.col(name), F.col(f"_carry_{name}"))


def _extreme(kind: str):
    return F.max if kind == "max" else F.min


# --------------------------------------------------------------------------
# trailing time frames


@dataclass(frozen=True)
class _Frame:
    kind: str
    value: Column
    start: int
    end: int | None


def frame_sum(value: Column, start_us: int, end_us: int | None = None) -> _Frame:
    """Sum of whole numbers over rows with ``at - start <= at' < at - end``.
    Without ``end`` the frame closes at this row (rows of equal time count only
    when they come before it)."""
    return _Frame("sum", value, start_us, end_us)


def frame_count(value: Column, start_us: int, end_us: int | None = None) -> _Frame:
    return _Frame("count", value, start_us, end_us)


def frame_list(value: Column, start_us: int) -> _Frame:
    return _Frame("list", value, start_us, None)


def frame_earliest(value: Column, start_us: int) -> _Frame:
    """First row of the frame, if it comes before this one.  ``value`` is a struct
    that starts with ``at_us, seq``."""
    return _Frame("earliest", value, start_us, None)


def trailing(
    df: DataFrame,
    keys: list[str],
    layout: Layout,
    order: list[str] | None = None,
    **frames: _Frame,
) -> DataFrame:
    """Add trailing time frames over ``at_us``.

    A frame needs only the rows of its span, so a split session is cut by time
    and every slice also receives the rows of one span before it (the halo),
    which are dropped afterwards.
    """
    order = order or ["seq"]
    cols = df.columns
    part = list(keys)
    if layout.split:
        span = max(f.start for f in frames.values())
        width = max(layout.segment_us or 1, span + 1)
        own = F.floor(F.col("at_us") / width).cast("bigint")
        reaches_next = F.pmod(F.col("at_us"), F.lit(width)) + span >= width
        df = (
            df.withColumn("_own", own)
            .withColumn(
                "_slice",
                F.explode(
                    F.when(reaches_next, F.array(F.col("_own"), F.col("_own") + 1))
                    .otherwise(F.array("_own"))
                ),
            )
        )
        part.append("_slice")
    # The finest order first: all other frames then find their rows sorted.
    in_order = Window.partitionBy(*part).orderBy("at_us", *order)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = []
    for n, f in frames.items():
        if f.kind == "earliest":
            ahead.append(F.lead(f.value).over(in_order).alias(f"_next_{n}"))
        elif f.kind != "list" and f.end is None:
            ahead.append(_total(f, upto).alias(f"_upto_{n}"))
    df = df.select("*", *ahead)
    out = df.select("*", *[_frame(n, f, part, order).alias(n) for n, f in frames.items()])
    if layout.split:
        out = out.where("_slice = _own")
    return out.select(*cols, *frames)


def _total(f: _Frame, over) -> Column:
    agg = F.sum if f.kind == "sum" else F.count
    return F.coalesce(agg(f.value).over(over), F.lit(0)).cast("bigint")


def _frame(name: str, f: _Frame, part: list[str], order: list[str]) -> Column:
    by_time = Window.partitionBy(*part).orderBy("at_us")
    if f.kind == "earliest":
        # The row after the last one before the frame; without such a row, the
        # very first.  Both come from frames that only grow.
        outside = by_time.rangeBetween(Window.unboundedPreceding, -f.start - 1)
        last_out = F.max(F.struct("at_us", "seq", F.col(f"_next_{name}").alias("next"))).over(outside)
        start = F.min(f.value).over(by_time.rangeBetween(Window.unboundedPreceding, 0))
        first = F.coalesce(last_out["next"], start)
        return F.when(first["seq"] != F.col("seq"), first)
    if f.kind == "list":
        peers = (
            Window.partitionBy(*part, "at_us")
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        earlier = by_time.rangeBetween(-f.start, -1)
        return F.concat(
            F.collect_list(f.value).over(earlier), F.collect_list(f.value).over(peers)
        )

    def before(offset: int) -> Column:
        """Everything more than ``offset`` back.  A frame that only grows costs
        one step per row, a sliding one is summed again for every row."""
        return _total(f, by_time.rangeBetween(Window.unboundedPreceding, -offset - 1))

    if f.end is not None:
        return before(f.end) - before(f.start)
    # Rows without a time come first and are their own frame.
    upto = F.col(f"_upto_{name}")
    return F.when(F.col("at_us").isNull(), upto).otherwise(upto - before(f.start))


# --------------------------------------------------------------------------
# lineage cuts


def settle(df: DataFrame, layout: Layout) -> DataFrame:
    """Cut the plan before a split prefix reads its input twice, so that chained
    prefixes cost one pass each instead of doubling.  Reliable checkpoint only:
    it outlives lost executors."""
    return materialize(df) if layout.split else df


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate once to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table with one row a session is sent to every task up to this many rows.
BROADCAST_ROWS = 500_000


def per_session(df: DataFrame) -> DataFrame:
    """A few numbers of each session, written once; sent to every task where few enough."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local session may make its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    shared = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        shared = shared_folder(spark)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared)
