"""Embedding near-dedup with an inverted multi-index.

Babenko and Lempitsky's index: each half of the unit vectors has a codebook of its own,
and the products of their cells form a grid.  A vector visits cells in order of the sum
of its two distances (multi-sequence order) up to a bound that is fitted so that a
vector at the least similarity lies in a visited cell with the target recall.  All rows
are indexed and all are queries; a pair counts if either side visits the other's cell.
Candidates are verified by cosine in double precision.

Equal vectors of a label are one representative with a count, so exact copies never meet.
Cells and their visitors are cut into blocks, and a task returns sums of links and a
forest, never pairs, so a crowded cell is many tasks of bounded size.

Null, empty and zero vectors, vectors with null or non-finite components, null labels
and null ids link with nothing.  Vectors of different length are never compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Forest, runs_of
from .common import bounded_sample, settle
from .components import components

LEAST_COSINE = 0.93
#: Share of pairs at the least similarity whose cell one side alone visits.
TARGET_RECALL = 0.99
#: Vectors the codebooks are fitted on, at most.
SAMPLE_ROWS = 8192
#: Vectors a cell of the largest label should hold.
CELL_ROWS = 128
MOST_CODES = 1024
BLOCK = 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # keeps very large and small ones in range
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1), 0)


def _codebook(x: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; empty cells move to random vectors."""
    c = x[rng.choice(len(x), min(codes, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        for k in range(len(c)):
            mine = x[near == k]
            c[k] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return c


@dataclass
class Grid:
    """Two codebooks for vectors of one length, and how far beyond the nearest cell to go."""

    left: np.ndarray
    right: np.ndarray
    slack: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return _distances(x[:, :h], self.left), _distances(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell and visited cells of unit vectors."""
        a, b = self.distances(x)
        own = a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)
        return own, [self.visited(p, q) for p, q in zip(a, b)]

    def visited(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells in multi-sequence order: by the sum of both distances, up to the bound.

        Rows and columns that no visited cell can have are left out first.
        """
        bound = a.min() + b.min() + self.slack
        i, j = np.flatnonzero(a <= bound - b.min()), np.flatnonzero(b <= bound - a.min())
        total = a[i][:, None] + b[j][None, :]
        r, c = np.nonzero(total <= bound)
        order = np.argsort(total[r, c], kind="stable")
        return (i[r] * len(self.right) + j[c])[order]


def fit_grid(x: np.ndarray, codes: int, least: float = LEAST_COSINE, recall: float = TARGET_RECALL, seed: int = 17) -> Grid:
    """Codebooks on unit vectors ``x``; the slack from pairs made at exactly the least cosine."""
    rng = np.random.default_rng(seed)
    half = max(1, x.shape[1] // 2)
    grid = Grid(_codebook(x[:, :half], codes, rng), _codebook(x[:, half:], codes, rng), 0.0)
    q = x[rng.integers(len(x), size=min(4096, 8 * len(x)))]
    noise = rng.standard_normal(q.shape)
    noise -= (noise * q).sum(axis=1, keepdims=True) * q
    size = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    y = least * q + np.sqrt(1 - least * least) * noise / np.where(size > 0, size, 1)
    a, b = grid.distances(q)
    ya, yb = grid.distances(y)
    rows = np.arange(len(q))
    beyond = a[rows, ya.argmin(axis=1)] + b[rows, yb.argmin(axis=1)] - a.min(axis=1) - b.min(axis=1)
    grid.slack = float(np.quantile(beyond, recall)) + 1e-9
    return grid


# --------------------------------------------------------------------------
# on tables


def _checked(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, key (128 bits of the vector) and vec; key is null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raw = [], [], []
            for v in batch.column(2):
                x = None
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if not np.isfinite(x).all() or not np.any(x):
                        x = None
                b = None if x is None else x.tobytes()
                keys.append(None if b is None else hashlib.blake2b(b, digest_size=16).digest())
                dims.append(None if x is None else len(x))
                raw.append(b)
            cols = [*batch.columns[:2], pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "dim", "key", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>"))
    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, dim int, key binary, vec binary")


def _grids(reps: DataFrame) -> dict[int, Grid]:
    """A grid for each vector length that the sample shows."""
    largest = {r["dim"]: r["n"] for r in reps.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}
    rows = bounded_sample(reps.select("rep", "dim", "vec"), reps.count(), SAMPLE_ROWS, F.col("rep")).collect()
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        x = unit(np.array([np.frombuffer(r["vec"]) for r in rows if r["dim"] == dim]))
        codes = int(np.clip(np.ceil(np.sqrt(largest[dim] / CELL_ROWS)), 1, MOST_CODES))
        out[dim] = fit_grid(x, codes)
    return out


def _indexed(reps: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """``reps`` with cell and visits.  A length without a grid has one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            vec = batch.column(4).to_pylist()
            cell, visits = np.zeros(len(dims), np.int32), [np.zeros(1, np.int64)] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in grids:
                    for a in range(0, len(at), 1024):
                        some = at[a : a + 1024]
                        own, seen = grids[dim].cells(unit(np.array([np.frombuffer(vec[i]) for i in some])))
                        cell[some] = own
                        for i, s in zip(some, seen):
                            visits[i] = s
            cols = [*batch.columns, pa.array(cell), pa.array(visits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "cell", "visits"])

    fields = [T.StructField("cell", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))]
    return reps.mapInArrow(run, T.StructType(reps.schema.fields + fields))


def _tasks(index: DataFrame) -> DataFrame:
    """Members and visitors of each cell, dealt to pairs of blocks."""
    place = ["label", "dim", "cell"]
    owners = index.groupBy(*place).count().withColumnRenamed("count", "_own")
    asked = index.select("rep", "label", "dim", F.explode("visits").alias("cell"), "copies", "vec", F.col("cell").alias("home"))
    visitors = asked.groupBy(*place).count().withColumnRenamed("count", "_asked")
    plan = owners.join(visitors, place)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    plan = plan.select(*place, blocks("_own").alias("_b"), blocks("_asked").alias("_q"))
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = index.join(plan, place).withColumn("b", spot("_b")).withColumn("q", each("_q"))
    query = asked.join(plan, place).withColumn("q", spot("_q")).withColumn("b", each("_b"))
    names = [*place, "b", "q", "rep", "copies", "vec"]
    base = base.select(*names, F.lit(0).alias("home"), "visits", F.lit(True).alias("is_base"))
    none = F.lit(None).cast("array<int>").alias("visits")
    return base.unionByName(query.select(*names, "home", none, F.lit(False).alias("is_base")))


def _linked(t: pa.Table, least: float) -> tuple[list, list, list]:
    """(vector, null, links) and (vector, vector, null) of the pairs of one task."""
    is_base = t.column("is_base").to_numpy()
    if is_base.all() or not is_base.any():
        return [], [], []
    ids, copies, home = (t.column(c).to_numpy() for c in ("rep", "copies", "home"))
    x = unit(np.array([np.frombuffer(v) for v in t.column("vec").to_pylist()]))
    b, q = np.flatnonzero(is_base), np.flatnonzero(~is_base)
    close = (x[q] @ x[b].T >= least) & (ids[q][:, None] != ids[b][None, :])
    if not close.any():
        return [], [], []
    # Whether the member visits the cell of the visitor: then it counts the pair itself.
    visits = t.column("visits").take(pa.array(b)).to_pylist()
    back = np.zeros(close.shape, bool)
    for j, seen in enumerate(visits):
        back[:, j] = np.isin(home[q], seen)
    found = close @ copies[b]
    given = (close & ~back).T @ copies[q]
    forest = Forest()
    for i, j in zip(*np.nonzero(close)):
        forest.link(int(ids[q[i]]), int(ids[b[j]]))
    n = np.concatenate([found, given])
    who = np.concatenate([ids[q], ids[b]])[n > 0].tolist()
    n = n[n > 0].tolist()
    return who + forest.u, [None] * len(who) + forest.v, n + [None] * len(forest.u)


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``."""
    checked = settle(_checked(vectors), "vectors")
    usable = checked.where("key is not null and label is not null and vec_id is not null")
    groups = settle(usable.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "groups")
    named = groups.withColumn("vec_id", F.col("rep"))
    reps = usable.join(named, ["label", "key", "vec_id"]).dropDuplicates(["label", "key"])
    reps = settle(reps.select("rep", "label", "dim", "copies", "vec"), "reps")
    index = settle(_indexed(reps, _grids(reps)), "index")
    keys = ["label", "dim", "cell", "b", "q"]
    pairs = runs_of(
        _tasks(index), keys, lambda t: _linked(t, least), [("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())]
    )
    pairs = settle(pairs, "pairs")
    links = pairs.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("_n"))
    classes = components(pairs.where("v is not null").select("u", "v"))
    classes = classes.select(F.col("node").alias("rep"), "component_id")
    found = groups.join(links, "rep", "left").join(classes, "rep", "left").select(
        "label", "key",
        (F.col("copies") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"),
        F.coalesce("component_id", "rep").alias("_component"),
    )
    out = checked.select("vec_id", "label", "key").join(found, ["label", "key"], "left")
    linked = F.col("vec_id").isNotNull() & F.col("_links").isNotNull()
    component = F.when(linked, F.col("_component")).otherwise(F.col("vec_id"))
    n = F.when(linked, F.col("_links")).otherwise(0)
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
