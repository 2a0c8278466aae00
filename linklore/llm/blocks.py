"""All pairs of different classes inside groups, in blocks of bounded size.

The largest class of a group may be huge: its members meet only the others, never each
other.  Rows go to tasks (pairs of blocks) of at most ``2 * BLOCK`` rows; what a task
returns is a forest over classes, not pairs, so rows out never exceed rows in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, comp, ...) once for each task that needs it, as ``task``."""
    sizes = rows.groupBy("key", "comp").count()
    largest = F.max(F.struct("count", "comp"))
    plan = sizes.groupBy("key").agg(largest.alias("_top"), F.sum("count").alias("_n")).where(
        F.col("_n") > F.col("_top.count")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = plan.select(
        "key",
        F.col("_top.comp").alias("_main"),
        blocks(F.col("_top.count")).alias("_g"),
        blocks(F.col("_n") - F.col("_top.count")).alias("_o"),
        (F.col("_n") <= 2 * BLOCK).alias("_one"),
    )
    main = F.col("comp") == F.col("_main")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("k"), i.alias("i"), j.alias("j"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    zero = F.lit(0)
    tasks = (
        F.when(F.col("_one"), F.array(task(0, zero, zero)))
        .when(main, F.transform(each("_o"), lambda x: task(2, x, at("_g"))))
        .otherwise(
            F.concat(
                F.transform(each("_o"), lambda x: task(1, F.least(x, at("_o")), F.greatest(x, at("_o")))),
                F.transform(each("_g"), lambda x: task(2, at("_o"), x)),
            )
        )
    )
    out = rows.join(plan, "key").withColumn("_task", F.explode(tasks))
    return out.select("key", "_task.k", "_task.i", "_task.j", *[c for c in rows.columns if c != "key"])


def runs_of(
    rows: DataFrame, keys: list[str], work: Callable[[pa.Table], tuple], columns: list[tuple[str, pa.DataType]]
) -> DataFrame:
    """Columns of longs from ``work`` on the rows of every key, one key at a time.

    Keys are brought together and in order by Spark; a task holds the rows of one key.
    """
    names, types = [n for n, _ in columns], [t for _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(work(table), types)], names)

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            changes = np.zeros(max(0, table.num_rows - 1), bool)
            for key in keys:
                v = table.column(key).to_numpy()
                changes |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield done(table.slice(a, b - a))
            rest = table.slice(cuts[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield done(rest)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def by_task(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], tuple[list, list]]) -> DataFrame:
    """Edges (u, v) from ``work`` on the rows of every key."""
    return runs_of(rows, keys, work, [("u", pa.int64()), ("v", pa.int64())])


class Forest:
    """Union-find over the classes of one task."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}
        self.u: list[int] = []
        self.v: list[int] = []

    def root(self, x: int) -> int:
        path = []
        while (y := self.above.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.above[p] = x
        return x

    def link(self, a: int, b: int) -> None:
        """Joins two classes and notes the edge."""
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.above[max(ra, rb)] = min(ra, rb)
            self.u.append(a)
            self.v.append(b)
