"""Mixing sources to target weights by cube-method balanced sampling.

Deville and Tille's cube method: inclusion probabilities move along vectors that leave
the balancing totals (tokens and documents of each source) unchanged until they reach 0
or 1.  The flight runs in blocks of ``BLOCK`` documents of one source; each leaves at
most two documents undecided, which meet again in the next, much smaller round, until
one block a source is left, whose last documents are rounded (landing).

A document is taken floor(target / source size) times and once more if it is chosen.
Documents without words are never taken and move nothing.  Null sources are a source of
their own, last in order.  Rows that repeat id, source and text are drawn one by one.
Draws come from hashes and seeded generators, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_nulls, keeps_columns, settle

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST_REPEATS = 2
#: Documents of one flight.
BLOCK = 4096
#: Documents of the landing problem, at most; all their roundings are tried.
_LANDING = 16
_EDGE = 1e-9


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size and target of every source of ``sizes`` (source, size, copies).

    The level at which targets stand in proportion to weight solves
    sum(min(MOST_REPEATS * size, level * weight)) = TOTAL * sum(size).
    One row for each source is ordered in one task, as their order and level are global.
    """
    each = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    each = each.withColumn("rank", F.row_number().over(in_order) - 1)
    each = each.withColumn("_w", F.get(weights, F.pmod("rank", F.lit(len(WEIGHTS)))))
    each = each.withColumn("_most", MOST_REPEATS * F.col("source_size"))
    fill = Window.orderBy(F.col("_most") / F.col("_w"), "rank")
    everywhere = Window.partitionBy()
    before = F.coalesce(F.sum("_most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("_level", (TOTAL * F.sum("source_size").over(everywhere) - before) / after)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_most"), F.col("_level"))
    # Levels fall to the right one as more sources are capped; the first that fits is it.
    each = each.withColumn("_level", F.max(fits).over(everywhere))
    target = F.least(F.col("_most").cast("double"), F.col("_level") * F.col("_w"))
    return each.select("source", "rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


# --------------------------------------------------------------------------
# the flight


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves ``p`` in the null space of (size, 1), three entries at a time in order, until
    at most two entries lie inside (0, 1)."""
    p = p.copy()
    draws = rng.random(2 * len(p) + 8)
    used = 0
    held: list[int] = []
    coming = iter(np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE)).tolist())
    while True:
        while len(held) < 3:
            k = next(coming, None)
            if k is None:
                return p
            held.append(k)
        a, b, c = held
        u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(held, u) if x)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(held, u) if x)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        rest = []
        for k, x in zip(held, u):
            v = p[k] + step * x
            p[k] = 0.0 if v < _EDGE else 1.0 if v > 1 - _EDGE else v
            if 0 < p[k] < 1:
                rest.append(k)
        held = rest


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides everything.  ``_LANDING`` entries of all sizes stay out of the flight of the
    others; of all roundings of what is then open, the best balanced one is taken."""
    p = p.copy()
    inside = lambda: np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    open_ = inside()
    if len(open_) > _LANDING:
        apart = open_[np.unique(np.linspace(0, len(open_) - 1, _LANDING - 2).astype(int))]
        flown = p.copy()
        flown[apart] = 0
        flown = flight(flown, size, rng)
        flown[apart] = p[apart]
        p = flown
        open_ = inside()
    taken = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(taken @ size[open_] - p[open_] @ size[open_])
    documents = np.abs(taken.sum(axis=1) - p[open_].sum())
    usual = max(1.0, float(np.median(size))) if len(size) else 1.0
    p[open_] = taken[int(np.argmin(words / usual + 0.05 * documents))]
    return np.round(p)


def _flown(units: DataFrame, last: bool) -> DataFrame:
    """``units`` (rank, block, unit, size, p) with ``p`` after the flight of each block."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "id", "h", "copy"], ascending=False, na_position="last", ignore_index=True)
        rng = np.random.default_rng([int(key[0]), int(key[1]), len(rows)])
        size = rows["size"].to_numpy(float)
        p = rows["p"].to_numpy(float)
        rows["p"] = (landing if last else flight)(p, size, rng)
        return rows

    return units.groupBy("rank", "block").applyInPandas(run, units.schema)


def choose(units: DataFrame) -> DataFrame:
    """Decides every unit (rank, id, h, copy, size, p): ``p`` becomes 0 or 1."""
    units = units.withColumn("order", F.xxhash64("id", "h", "copy", "rank"))
    decided: DataFrame | None = None
    for level in range(64):
        counts = units.groupBy("rank").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
        most = counts.agg(F.max("_blocks")).first()[0] or 0
        blocks = F.pmod(F.xxhash64("order", F.lit(level)), F.col("_blocks")).cast("int")
        here = units.drop("block").join(counts, "rank").withColumn("block", blocks).drop("_blocks")
        flown = settle(_flown(here, most <= 1), f"flight-{level}")
        done = flown if most <= 1 else flown.where("p = 0 or p = 1")
        decided = done if decided is None else decided.unionByName(done)
        if most <= 1:
            break
        units = flown.where("p > 0 and p < 1")
    return decided.drop("order", "block")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, text hash ``h``, size, source_size, target, and how often each row is
    taken (``times``, ``taken`` in words).  Equal rows are numbered by ``copy``."""
    rows = docs.select(
        F.col("doc_id").alias("id"), "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size")
    )
    grouped = settle(rows.groupBy("id", "source", "h", "size").agg(F.count("*").alias("copies")), "sizes")
    goals = settle(targets(grouped), "targets")
    share = F.col("target") / F.greatest("source_size", F.lit(1))
    base = F.when(F.col("size") > 0, F.least(F.floor(share), F.lit(MOST_REPEATS))).otherwise(0)
    units = join_nulls(grouped, goals, ["source"])
    units = units.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    units = units.withColumn("_base", base).withColumn("p", F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0))
    units = settle(units, "units")
    open_ = (F.col("p") > _EDGE) & (F.col("p") < 1 - _EDGE)
    moved = choose(units.where(open_).select("rank", "id", "h", "copy", "size", "p"))
    chosen = moved.where("p = 1").select("rank", "id", "h", "copy", F.lit(1).alias("_one"))
    out = join_nulls(units, chosen, ["id", "h", "copy", "rank"], "left")
    sure = F.when(F.col("p") >= 1 - _EDGE, 1).otherwise(0)
    times = (F.col("_base") + sure + F.coalesce("_one", F.lit(0))).cast("long")
    return out.select(
        F.col("id").alias("doc_id"), "source", "h", "copy", "size", "source_size", "target",
        times.alias("times"), (times * F.col("size")).alias("taken"),
    )


@keeps_columns("doc_id", "source", "text")
def mixed_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them."""
    drawn = mix(docs).where("times > 0").select("doc_id", "source", F.col("h").alias("_h"), F.col("copy").alias("_copy"), F.col("times").alias("_times"))
    names = docs.columns
    rows = docs.withColumn("_h", F.xxhash64("text"))
    same = Window.partitionBy("doc_id", "source", "_h").orderBy(F.lit(0))
    rows = rows.withColumn("_copy", F.row_number().over(same))
    out = join_nulls(rows, drawn, ["doc_id", "source", "_h", "_copy"])
    return out.select(*names, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_time")).drop("_time")
