"""Byte-level BPE by content-defined chunks.

A rolling hash over the last 32 bytes decides where a text is cut, so a passage that
several documents share is cut alike in all of them.  A chunk is encoded the first time a
worker meets it and taken from its dictionary afterwards; the dictionary holds a bounded
number of bytes and gives up what was not used for longest.

Chunks are cut anywhere, also inside words, so the ids beside a join may be wrong.  A join
is repaired by encoding a window again: from a *sure* place of the left chunk to one of
the right chunk.  Sure places (a visible character before a space or line end, a common
letter or digit before punctuation) end a word of the tokenizer whatever surrounds them.
The window holds one more stretch between sure places on either side, and is accepted when
its ids there agree with both chunks'.  Without agreement, or in a chunk without two sure
places, the chunks become one that is encoded anew, twice as many each time, so that a
text without any sure place costs a few encodings of the whole.

The tables come from the tokenizer's file; its merges must be in the order of their ids,
so that words can be encoded by rank.  Truncation and padding are not applied.

Null and empty texts have no ids.  Repeated rows are encoded as often as they come, from the
dictionary.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One of so many bytes ends a chunk; beyond the longest a chunk is cut in any case.
AVERAGE, LONGEST = 2048, 32_768
#: Bytes of chunks a worker remembers.
_REMEMBERED = 24 << 20
_TAIL = 48  # characters in which the last sure places are looked for first
_REACH = 32  # bytes the rolling hash looks back, one for each of its bits
#: Bytes cut at a time.
_TOGETHER = 1 << 20

#: The words of the tokenizer family, and places that always end one.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SURE = re.compile(
    r"\S(?=[ \n])|[0-9A-Za-zА-яぁ-ゖァ-ヺ一-龥가-힣](?=[.,!?;:、。，！？])"
)
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Where chunks of UTF-8 bytes end (exclusive), the last byte's end not included."""
    h = _GEAR[data]
    step = 1
    while step < _REACH:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    ends = np.flatnonzero(h[:-1] < np.uint32((1 << 32) // AVERAGE)) + 1
    return ends[(data[ends] & 0xC0) != 0x80]  # not inside a character


def chunks_of(raw: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each text, cut by its own content alone."""
    first = 0
    while first < len(raw):
        last, total = first, 0
        while last < len(raw) and (last == first or total + len(raw[last]) <= _TOGETHER):
            total += len(raw[last]) + _REACH
            last += 1
        joined = bytes(_REACH).join(raw[first:last])
        ends = cut_points(np.frombuffer(joined, np.uint8)) if joined else np.empty(0, np.int64)
        at = 0
        for text in raw[first:last]:
            lo, hi = np.searchsorted(ends, [at + 1, at + len(text)])
            yield _divided(text, (ends[lo:hi] - at).tolist())
            at += len(text) + _REACH
        first = last


def _divided(text: bytes, ends: list[int]) -> list[bytes]:
    out, at = [], 0
    for end in (*ends, len(text)):
        while end - at > LONGEST:
            stop = at + LONGEST
            while text[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(text[at:stop])
            at = stop
        if end > at:
            out.append(text[at:end])
        at = end
    return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of such tokenizers, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Chunk:
    """An encoded chunk.  ``sure``: the places that joins use, as (byte, index of the id that
    begins there): the first two, then the last two."""

    __slots__ = ("raw", "ids", "sure")

    def __init__(self, raw: bytes, ids: np.ndarray, lengths: np.ndarray):
        self.raw, self.ids, self.sure = raw, ids, None
        text = raw.decode()
        tail = max(0, len(text) - _TAIL)
        last = [m.end() + tail for m in _SURE.finditer(text[tail:])]
        if len(last) < 2:
            last = [m.end() for m in _SURE.finditer(text)]
        if len(last) >= 2:
            picked = (*(m.end() for m in islice(_SURE.finditer(text), 2)), *last[-2:])
            if len(raw) != len(text):
                picked = tuple(len(text[:i].encode()) for i in picked)
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, picked)
            if (ends[at] == picked).all():  # else an id reaches over the place
                self.sure = list(zip(picked, (at + 1).tolist()))


class ChunkCoder:
    """Encodes and decodes texts as the tokenizer of a file does."""

    def __init__(self, path: str, remembered: int = _REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self._check(spec, vocab, ranks)
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for raw, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_of[i] = raw
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.letters = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.special = list(special)
        self.ranked = tiktoken.Encoding("chunks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.known: OrderedDict[bytes, Chunk] = OrderedDict()
        self.held, self.remembered = 0, remembered
        self.encoded = 0  # bytes that were encoded, repairs included

    @staticmethod
    def _check(spec: dict, vocab: dict[str, int], ranks: dict[bytes, int]) -> None:
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        before = spec.get("pre_tokenizer") or {}
        plain = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and not spec["model"].get("ignore_merges") and ids == sorted(ids) and len(ranks) == 256 + len(ids)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])
            and not any(re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        if not plain:
            raise ValueError("chunks need a byte-level BPE whose merges are in the order of their ids")

    def whole(self, raw: bytes) -> np.ndarray:
        """Ids of a text by itself."""
        self.encoded += len(raw)
        text = raw.decode()
        special = [t for t in self.special if t in text]
        return self.ranked.encode_to_numpy(text, allowed_special=set(special), disallowed_special=())

    def chunk(self, raw: bytes) -> Chunk:
        found = self.known.get(raw)
        if found is None:
            found = self.known[raw] = Chunk(raw, self.whole(raw), self.lengths)
            self.held += len(raw) + found.ids.nbytes
            while self.held > self.remembered and len(self.known) > 1:
                _, old = self.known.popitem(last=False)
                self.held -= len(old.raw) + old.ids.nbytes
        else:
            self.known.move_to_end(raw)
        return found

    def _joint(self, a: Chunk, b: Chunk) -> np.ndarray | None:
        """Ids between the last sure place of ``a`` and the first of ``b``, if they agree."""
        if a.sure is None or b.sure is None:
            return None
        (low, i), (_, j) = a.sure[2:]
        (_, k), (high, m) = b.sure[:2]
        ids = self.whole(a.raw[low:] + b.raw[:high])
        left, right = a.ids[i:j], b.ids[k:m]
        if len(ids) < len(left) + len(right):
            return None
        if not (np.array_equal(ids[: len(left)], left) and np.array_equal(ids[len(ids) - len(right) :], right)):
            return None
        return ids[len(left) : len(ids) - len(right)]

    def encode(self, chunks: list[bytes]) -> np.ndarray:
        """Ids of the text that these chunks make up."""
        if not chunks:
            return np.empty(0, np.uint32)
        done: list[np.ndarray] = []
        current, start, at, more = self.chunk(chunks[0]), 0, 1, 1
        while at < len(chunks):
            following = self.chunk(chunks[at])
            joint = self._joint(current, following)
            if joint is not None:
                done += [current.ids[start : current.sure[3][1]], joint]
                current, start, at, more = following, following.sure[0][1], at + 1, 1
            else:
                raw = current.raw + b"".join(chunks[at : at + more])
                current = Chunk(raw, self.whole(raw), self.lengths)
                at, more = at + more, 2 * more
        return np.concatenate([*done, current.ids[start:]])

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.first[ids] - ends + lengths, lengths)
        return self.letters[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def chunk_coder(path: str) -> ChunkCoder:
    """The worker's coder: its dictionary outlives a task."""
    return ChunkCoder(path)


def encode_texts(coder: ChunkCoder, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text."""
    yield from map(coder.encode, chunks_of([(t or "").encode() for t in texts]))


def coded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _by_batch(docs, tokenizer, schema, lambda coder, ids: (ids.astype(np.int32),), [pa.list_(pa.int32())])


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (little-endian, 32 bits) and of the decoded text."""
    names = ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in names]])

    def digest(coder: ChunkCoder, ids: np.ndarray) -> tuple:
        text = coder.decode(ids)
        return len(ids), hashlib.sha256(ids.astype("<u4")).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _by_batch(docs, tokenizer, schema, digest, [pa.int64(), pa.string(), pa.string()])


def _by_batch(docs, tokenizer: str, schema: T.StructType, made, types: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_coder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [made(coder, ids) for ids in encode_texts(coder, part.column(1).to_pylist())]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
