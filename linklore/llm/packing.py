"""Packing documents into sequences: shortest-pack-first over the length histogram.

Documents are tokenised once and cut into full sequences and a rest.  Of the rests only
the histogram of lengths (at most as many rows as a sequence has tokens) goes to the
driver: lengths, longest first, go into the pack that is shortest so far if they fit,
whole counts of equal packs at a time.  The outcome is a list of patterns with counts;
each piece finds its place by its rank among pieces of its length.  Ranks are counted in
salted parts, so a length that a third of all pieces share is no single task.

Null and empty texts have the closing id alone; repeated rows are packed one by one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle
from .tokens import word_encoder

SEQUENCE = 2048
CLOSING_ID = 1
#: Pieces of one length ranked in one part.
_PART_ROWS = 2000
_TOGETHER = 512


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, nth (of its task)."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "nth")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nth = word_encoder(tokenizer), 0
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(a, _TOGETHER)
                owner, start, length, crc, tokens = [], [], [], [], []
                for i, ids in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += closing
                    for at in range(0, len(ids), 4 * sequence):
                        piece = ids[at : at + 4 * sequence]
                        owner.append(i)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        tokens.append(len(ids) // 4)
                cols = [part.column(0).take(pa.array(owner, pa.int32()))]
                cols += [pa.array(c, pa.int64()) for c in (start, length, crc, tokens)]
                cols.append(pa.array(range(nth, nth + len(owner)), pa.int64()))
                nth += len(owner)
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


# --------------------------------------------------------------------------
# patterns


@dataclass
class Places:
    """For each length its slots: first rank, first sequence, offset in the sequence."""

    first: np.ndarray  # of each length, the first slot; one more at the end
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        slot = np.empty(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            lo, hi = self.first[n], self.first[n + 1]
            slot[mine] = lo + np.searchsorted(self.rank[lo:hi], rank[mine], side="right") - 1
        return self.sequence[slot] + rank - self.rank[slot], self.offset[slot]


def shortest_pack_first(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of every packing pattern; the lengths fall."""
    packs: list[tuple[int, tuple[int, ...], int]] = []  # heap: tokens so far, lengths, how many
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if packs and packs[0][0] + length <= sequence:
                total, lengths, many = heapq.heappop(packs)
                used = min(many, left)
                if used < many:
                    heapq.heappush(packs, (total, lengths, many - used))
            else:
                total, lengths, used = 0, (), left
            heapq.heappush(packs, (total + length, (*lengths, length), used))
            left -= used
    return [(many, lengths) for _, lengths, many in sorted(packs)]


def places(patterns: list[tuple[int, tuple[int, ...]]], sequence: int = SEQUENCE) -> Places:
    slots: dict[int, list[tuple[int, int, int]]] = {}
    number = 0
    for many, lengths in patterns:
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((many, number, offset))
            offset += length
        number += many
    first, rank, start, offset = [0], [], [], []
    for length in range(sequence + 1):
        done = 0
        for many, at, off in slots.get(length, []):
            rank.append(done)
            start.append(at)
            offset.append(off)
            done += many
        first.append(len(rank))
    as_array = lambda v: np.array(v, np.int64)
    return Places(as_array(first), as_array(rank), as_array(start), as_array(offset), number)


def _ranked(cut: DataFrame, counts: dict[int, int], sequence: int) -> DataFrame:
    """``cut`` with the rank (from 0) of each piece among those of its length."""
    parts = F.array(*[F.lit(-(-counts.get(n, 0) // _PART_ROWS) or 1) for n in range(sequence + 1)])
    salted = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "nth"), F.get(parts, F.col("length").cast("int"))))
    sizes = salted.groupBy("length", "_part").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "nth")
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1).join(sizes, ["length", "_part"])
    return ranked.withColumn("_rank", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row for each piece, with its sequence and offset."""
    cut = settle(pieces(docs, tokenizer, sequence), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``sequence`` rows
    found = places(shortest_pack_first(counts, sequence), sequence)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, offset = found.find(batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at), pa.array(offset)], names)

    schema = T.StructType([cut.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in names[1:]])
    ranked = _ranked(cut, counts, sequence).select(*names[:5], "_rank")
    return ranked.mapInArrow(run, schema)
