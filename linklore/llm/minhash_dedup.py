"""Near-duplicate documents by MinHash: bands, signatures, full sets, components.

1. Every text becomes a set of word shingles.  Equal sets are one representative.
2. Minima of universal hash functions, in bands; representatives that agree in a band
   share a bucket.  Nothing is written for buckets of one.
3. Star: members meet the smallest of their bucket.  Pairs whose signatures agree are
   confirmed on full sets, and confirmed links become classes (large-star, small-star).
4. The rest: in buckets that still hold several classes, pairs of different classes are
   compared in blocks, first by signature (which gives groups), then within a group on
   full sets.  So no bucket is capped, and no pair list is ever written.

With 32 bands of 4 a pair at similarity 0.75 shares no bucket in 5 of a million cases,
and four standard deviations separate the signature bound from 0.75.

Null, empty and wordless texts have an empty set, link with nothing and are kept.  A row
without an id links with nothing, has no component and is kept.  Rows that repeat an id
are judged by their own texts.  Shorter texts than a shingle are one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Forest, by_task, dealt
from .common import keeps_columns, parts_of, settle
from .components import components
from .rolling import mixed
from .shingles import SHINGLE_WORDS, MinHashes, set_key, shingle_sets

#: Bits of the broadcast filter of ids; its size is fixed, 4 MB.
_FILTER_BITS = 1 << 25
_BITMAP = 1 << 15


@dataclass(frozen=True)
class Banding:
    bands: int = 32
    rows: int = 4
    percent: int = 75
    words: int = SHINGLE_WORDS

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal minima below which a pair is surely under the threshold."""
        s = self.percent / 100
        return math.floor(self.hashes * (s - 4 * math.sqrt(s * (1 - s) / self.hashes)))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Similarity of two full sets, in whole numbers."""
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    return batch.column(i).cast(pa.large_binary()).to_pylist()


def _sets(docs: DataFrame, p: Banding) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key and the keys of all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHashes(p.hashes)
        salt = mixed(np.arange(1, p.bands + 1, dtype=np.uint64))
        for batch in parts_of(batches):
            n, keys, bands = [], [], []
            for s in shingle_sets(_texts(batch, 2), p.words):
                n.append(len(s))
                keys.append(set_key(s))
                minima = family.of(s).astype(np.uint64).reshape(p.bands, p.rows)
                h = salt.copy()
                for j in range(p.rows):
                    h = mixed(h + minima[:, j])
                bands.append(h.tobytes() if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names)

    names = ["doc_id", "text_hash", "n_shingles", "set_key", "bands"]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands binary")


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a in range(0, len(ids), 2000):
            part = batch.column(1).slice(a, 2000).to_pylist()
            keys = np.frombuffer(b"".join(part), np.int64)
            owner = np.repeat(ids[a : a + 2000], len(keys) // max(1, len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owner)], ["key", "id"])


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A fixed number of bits with one set for each id of ``ids``."""
    bit = F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS))
    parts = ids.select((bit / _BITMAP).cast("int").alias("part"), (bit % _BITMAP).alias("bit"))
    maps = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # 4 MB at most
    out = np.zeros(_FILTER_BITS // 8, np.uint8)
    for r in maps:
        at = r["part"] * (_BITMAP // 8)
        out[at : at + _BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _full_sets(docs: DataFrame, ids: DataFrame, p: Banding) -> DataFrame:
    """id, signature bytes and full set of the documents in ``ids``."""
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, wanted = MinHashes(p.hashes), bits.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7)) & 1 == 1))
            for part in parts_of(iter([batch])):
                sets = list(shingle_sets(_texts(part, 1), p.words))
                signs = [(family.of(s) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets]
                cols = [
                    part.column(0), pa.array(map(set_key, sets), pa.binary()), pa.array(signs, pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "set_key", "sign", "items"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    rows = rows.withColumn("_bit", F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS)))
    found = rows.mapInArrow(run, "id long, set_key binary, sign binary, items binary")
    found = found.where("set_key is not null").join(ids, "id", "left_semi")
    return found.dropDuplicates(["id", "set_key"]).drop("set_key")


def _signs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _items(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _agreeing(pairs: DataFrame, signs: DataFrame, p: Banding) -> DataFrame:
    """Pairs (id, center) whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_signs(batch.column(2)) == _signs(batch.column(3))).sum(axis=1)
                yield batch.filter(pa.array(equal >= p.least_equal)).select([0, 1])

    left = signs.select("id", F.col("sign").alias("_a"))
    right = signs.select(F.col("id").alias("center"), F.col("sign").alias("_b"))
    both = pairs.join(right, "center").join(left, "id").select("id", "center", "_a", "_b")
    return both.mapInArrow(run, "id long, center long")


def _confirmed(pairs: DataFrame, full: DataFrame, p: Banding) -> DataFrame:
    """Pairs (id, center) that link on full sets, as u and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [p.linked(_items(x.as_py()), _items(y.as_py())) for x, y in zip(a, b)]
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1]).rename_columns(["u", "v"])

    left = full.select("id", F.col("items").alias("_a"))
    right = full.select(F.col("id").alias("center"), F.col("items").alias("_b"))
    both = pairs.join(right, "center").join(left, "id").select("id", "center", "_a", "_b")
    return both.mapInArrow(run, "u long, v long")


def _candidates(comp: np.ndarray, signs: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different classes whose signatures agree enough."""
    for i in range(len(comp) - 1):
        rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        if len(rest):
            near = (signs[rest] == signs[i]).sum(axis=1) >= least
            for j in rest[near]:
                yield i, int(j)


def _similar_classes(p: Banding):
    def work(t: pa.Table) -> tuple[list, list]:
        forest, comp = Forest(), t.column("comp").to_numpy()
        for i, j in _candidates(comp, _signs(t.column("sign")), p.least_equal):
            forest.link(int(comp[i]), int(comp[j]))
        return forest.u, forest.v

    return work


def _linked_classes(p: Banding):
    def work(t: pa.Table) -> tuple[list, list]:
        forest, comp = Forest(), t.column("comp").to_numpy()
        items = [_items(x) for x in t.column("items").to_pylist()]
        for i, j in _candidates(comp, _signs(t.column("sign")), p.least_equal):
            a, b = int(comp[i]), int(comp[j])
            if forest.root(a) != forest.root(b) and p.linked(items[i], items[j]):
                forest.link(a, b)
        return forest.u, forest.v

    return work


def _with_class(rows: DataFrame, classes: DataFrame, column: str = "id") -> DataFrame:
    """``comp`` of every row; a node without links is its own class."""
    named = classes.select(F.col("node").alias(column), F.col("component_id").alias("comp"))
    return rows.join(named, column, "left").withColumn("comp", F.coalesce("comp", column))


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """Members (key, id, comp) of buckets with several classes; of buckets with equal members, one."""
    shown = members.groupBy("key").agg(
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n"),
        F.bit_xor(F.xxhash64("id")).alias("_x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_y"),
    )
    keys = shown.where("_lo <> _hi").groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key")
    return members.join(keys, "key")


def near_duplicates(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row of ``docs``."""
    sets = settle(_sets(docs, p), "sets")
    named = sets.where("set_key is not null and doc_id is not null")
    reps = settle(named.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")

    own = named.join(reps.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"])
    own = own.dropDuplicates(["set_key", "doc_id"]).select("doc_id", "bands")
    bands = settle(own.mapInArrow(_band_rows, "key long, id long"), "bands")
    shared = bands.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("_last")).where("center <> _last")
    members = settle(bands.join(shared.drop("_last"), "key").distinct(), "members")

    full = settle(_full_sets(docs, members.select("id").distinct(), p), "full")
    signs = full.select("id", "sign")
    stars = members.where("id <> center").select("id", "center").distinct()
    links = settle(_confirmed(_agreeing(stars, signs, p), full, p), "links")
    first = components(links, "first")

    mixed_rows = settle(_mixed_buckets(_with_class(members.select("key", "id"), first)), "mixed")
    similar = by_task(dealt(mixed_rows.join(signs, "id")), ["key", "k", "i", "j"], _similar_classes(p))
    groups = components(similar, "groups").select(F.col("node").alias("comp"), F.col("component_id").alias("key"))
    grouped = _with_class(members.select("id").distinct(), first).join(groups, "comp").select("key", "id", "comp")
    grouped = settle(grouped, "grouped")
    later = by_task(dealt(grouped).join(full, "id"), ["key", "k", "i", "j"], _linked_classes(p))
    second = components(later, "second")

    final = _with_class(reps, first, "rep").select("set_key", F.col("comp").alias("_first"))
    final = _with_class(final, second, "_first").select("set_key", "comp")
    out = sets.select("doc_id", "text_hash", "n_shingles", "set_key").join(final, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"))


@keeps_columns("doc_id", "text")
def deduplicated(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """The rows of ``docs`` that are kept; of rows that repeat id and text, one."""
    verdict = near_duplicates(docs, p).where(~F.col("kept"))
    removed = verdict.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    # Rows without an id all stay, so they get numbers of their own and never meet.
    h = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
    rows = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_h", h)
    left = rows.join(removed, ["_id", "_h"], "left_anti")
    first = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_id"))
    return left.withColumn("_nth", first).where("_nth = 1").select(*docs.columns)
