"""Helpers of the training-data operators: tables in the shared folder, folds, bounded samples."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_HASH_SPAN = 1 << 30


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only where that is unset in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="linklore-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and it
    outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def place(*cols: Column) -> Column:
    """A stable pseudo-random place in [0, 2**30) of a row, for sampling and dealing."""
    return F.pmod(F.xxhash64(*cols), F.lit(_HASH_SPAN))


def bounded_sample(df: DataFrame, total: int, bound: int, *by: Column) -> DataFrame:
    """At most ``bound`` of the ``total`` rows of ``df``, chosen by hash of ``by``.

    The threshold thins the rows where they are, so only about ``bound`` rows are ordered.
    """
    if total > bound:
        share = min(1.0, (bound + 4 * math.sqrt(bound)) / total)
        df = df.where(place(*by) < F.lit(int(share * _HASH_SPAN)))
    return df.orderBy(place(*by), *by).limit(bound)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that Python holds few texts at a time besides the batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; ``right`` must have no other column of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def keeps_columns(*read: str) -> Callable:
    """For functions that give back rows of their first argument: they see the columns they
    ``read`` and the others under names of their own, so that no helper column can meet one."""

    def wrap(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(function)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            inner = {c: c if c in read else f"_other{i}" for i, c in enumerate(docs.columns)}
            out = function(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), *args, **kwargs)
            return out.select(*[F.col(n).alias(c) for c, n in inner.items()])

        return run

    return wrap
