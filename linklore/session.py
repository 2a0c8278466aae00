"""A SparkSession with the settings this package is tested with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_STORE = "spark.sql.streaming.stateStore.providerClass"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keeps state-store traffic of stateful Python operators off TCP ports.
    "spark.python.unix.domain.socket.enabled": "true",
    _STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int = 8, **extra: str) -> SparkSession:
    """Single-machine session; on a cluster pass ``SETTINGS`` to your own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linklore")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def keyed_state(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Streaming queries started inside keep their state in RocksDB, which the stateful operators
    need and a session of another maker may not have set, in ``tasks`` parts.  A query takes the
    settings it is started with; the session's own are back afterwards."""
    wanted = {_STORE: SETTINGS[_STORE], "spark.sql.shuffle.partitions": str(tasks)}
    held = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in held.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
