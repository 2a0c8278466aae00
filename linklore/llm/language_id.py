"""Language ID: a bidirectional gated recurrent network over bytes.

Every position of every text gets language probabilities; a document's are the mean
over its letter positions.  Whole texts are read, in windows of ``WINDOW`` bytes that
run side by side, so a text of any length costs constant memory.  The network is
trained here, in numpy, by backpropagation through time on a bounded sample of rows.

Null texts and texts without a letter are ``und`` with score 1; repeated rows get equal
predictions; with no labelled row everything is ``und``.

``spoken`` drops texts without a language.  Its network has one more class, ``und``, that
is trained on pieces whose letters are drawn at random, and limits are fitted on the
labelled rows that are not held out (``Limits``): a text goes when letters are too rare among
its visible characters, or when ``und`` is its most probable class and reaches a score that
is higher the fewer letters it has, as few letters prove little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, keeps_columns, parts_of, place, settle

UNKNOWN = "und"
#: Positions that run in one chain.
WINDOW = 128
#: Documents of each language the network is trained on, at most.
SAMPLE_ROWS = 240
#: Pieces read from each of them, spread over the text.
_PIECES = 6
_SIDE_BY_SIDE = 2048
#: Share of the labelled sample that lies below the values the limits start from.
_UNUSUAL = 0.001
#: Letters at which the limit of the score is half way down from 1.
_FEW_LETTERS = 64
_LETTER = regex.compile(r"\p{L}")
#: Bytes that belong to letters: ASCII letters and parts of longer characters.
_LETTER_BYTE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


@dataclass
class Chain:
    """One direction.  Rows of the gates: update, reset, candidate."""

    inputs: np.ndarray  # 3H x 256
    loops: np.ndarray  # 3H x H

    @property
    def size(self) -> int:
        return self.loops.shape[1]

    def halved(self) -> Chain:
        """Gate rows halved: sigmoid(x) is (tanh(x / 2) + 1) / 2."""
        scale = np.repeat(np.float32([0.5, 0.5, 1]), self.size)[:, None]
        return Chain(self.inputs * scale, self.loops * scale)

    def states(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """States after each row of ``x`` (positions x windows); the array is reused."""
        own, k = self.halved(), self.size
        h = np.zeros((k, x.shape[1]), np.float32)
        a = np.empty((3 * k, x.shape[1]), np.float32)
        u = np.empty_like(a)
        for row in x:
            np.take(own.inputs, row, axis=1, out=a, mode="clip")
            np.matmul(own.loops, h, out=u)
            gates, new = a[: 2 * k], a[2 * k :]
            gates += u[: 2 * k]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            u[2 * k :] *= gates[k:]
            new += u[2 * k :]
            np.tanh(new, out=new)
            h -= new
            h *= gates[:k]
            h += new
            yield h


@dataclass
class Network:
    classes: list[str]
    forward: Chain
    backward: Chain
    out: np.ndarray  # C x 2H
    bias: np.ndarray  # C

    def window_sums(self, x: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Probabilities of every position, summed over the ``counted`` ones of a window."""
        k, (steps, n) = self.forward.size, x.shape
        seen = np.empty((steps, k, n), np.float32)
        for t, h in enumerate(self.forward.states(x)):
            seen[t] = h
        total = np.zeros((len(self.bias), n), np.float32)
        left, right = self.out[:, :k], self.out[:, k:]
        for t, h in enumerate(self.backward.states(x[::-1])):
            at = steps - 1 - t
            p = left @ seen[at]
            p += right @ h
            p += self.bias[:, None]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= counted[at] / p.sum(axis=0)
            total += p
        return total

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of the texts ``data[offsets[i]:offsets[i + 1]]``; rows of
        texts without letter positions are zero."""
        lengths = np.diff(offsets)
        per_text = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(lengths)), per_text)
        first = np.repeat(np.cumsum(per_text) - per_text, per_text)
        starts = offsets[:-1][owner] + (np.arange(len(owner)) - first) * WINDOW
        ends = np.minimum(starts + WINDOW, offsets[1:][owner])
        sums = np.zeros((len(lengths), len(self.classes)))
        counts = np.zeros(len(lengths))
        steps = np.arange(WINDOW)[:, None]
        for i in range(0, len(owner), _SIDE_BY_SIDE):
            some = slice(i, i + _SIDE_BY_SIDE)
            at = starts[some] + steps
            inside = at < ends[some]
            x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
            counted = (inside & _LETTER_BYTE[x]).astype(np.float32)
            np.add.at(sums, owner[some], self.window_sums(x, counted).T)
            np.add.at(counts, owner[some], counted.sum(axis=0))
        return sums / np.maximum(counts, 1)[:, None]


# --------------------------------------------------------------------------
# training


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(chain: Chain, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    k, (steps, n) = chain.size, x.shape
    h = np.zeros((k, n), np.float32)
    states, kept = np.empty((steps, k, n), np.float32), []
    for t in range(steps):
        a, u = chain.inputs[:, x[t]], chain.loops @ h
        g = _sigmoid(a[: 2 * k] + u[: 2 * k])
        z, r = g[:k], g[k:]
        c = np.tanh(a[2 * k :] + r * u[2 * k :])
        kept.append((h, z, r, c, u[2 * k :]))
        h = c + z * (h - c)
        states[t] = h
    return states, kept


def _back(chain: Chain, x: np.ndarray, kept: list[tuple], given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``inputs`` and ``loops``; ``given``: those of the states."""
    k = chain.size
    d_in, d_loop = np.zeros_like(chain.inputs), np.zeros_like(chain.loops)
    dh = np.zeros_like(given[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c, u = kept[t]
        dh = dh + given[t]
        dc = dh * (1 - z) * (1 - c * c)
        da = np.concatenate([dh * (h - c) * z * (1 - z), dc * u * r * (1 - r), dc])
        du = np.concatenate([da[: 2 * k], dc * r])
        d_loop += du @ h.T
        for j, row in enumerate(da):
            d_in[j] += np.bincount(x[t], row, 256)
        dh = dh * z + chain.loops.T @ du
    return d_in, d_loop


def train(
    pieces: list[bytes], labels: list[str], size: int = 8, rounds: int = 260, batch: int = 192, seed: int = 11
) -> Network:
    """Fit on text pieces of at most WINDOW bytes (longer ones are cut)."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k, c = size, max(1, len(classes))
    x = np.zeros((len(pieces), WINDOW), np.uint8)
    inside = np.zeros((len(pieces), WINDOW), np.float32)
    for i, p in enumerate(pieces):
        p = p[:WINDOW]
        x[i, : len(p)] = np.frombuffer(p, np.uint8)
        inside[i, : len(p)] = 1
    y = np.array([classes.index(v) for v in labels])
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    weights = [
        draw(3 * k, 256, s=0.3), draw(3 * k, k, s=0.4), draw(3 * k, 256, s=0.3), draw(3 * k, k, s=0.4),
        draw(c, 2 * k, s=0.3), np.zeros(c, np.float32),
    ]
    moment, spread = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    groups = [np.flatnonzero(y == i) for i in range(len(classes))]
    for step in range(1, (rounds if len(classes) > 1 else 0) + 1):
        pick = np.concatenate([rng.choice(g, max(1, batch // c)) for g in groups])
        steps = 64
        at = rng.integers(0, WINDOW - steps + 1)
        xb = np.ascontiguousarray(x[pick, at : at + steps].T)
        mb = inside[pick, at : at + steps].T
        fwd, bwd = Chain(weights[0], weights[1]), Chain(weights[2], weights[3])
        hf, kept_f = _run(fwd, xb)
        hb, kept_b = _run(bwd, xb[::-1])
        hb = hb[::-1]
        both = np.concatenate([hf, hb], axis=1)
        p = np.einsum("ck,tkn->tcn", weights[4], both) + weights[5][:, None]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y[pick], np.arange(len(pick))] -= 1
        p *= (mb / max(mb.sum(), 1))[:, None, :]
        d_both = np.einsum("ck,tcn->tkn", weights[4], p).astype(np.float32)
        grads = [
            *_back(fwd, xb, kept_f, d_both[:, :k]), *_back(bwd, xb[::-1], kept_b, d_both[::-1, k:]),
            np.einsum("tcn,tkn->ck", p, both), p.sum(axis=(0, 2)),
        ]
        rate = 0.02 * (1 - step / (rounds + 1)) + 0.001
        for w, g, m, s in zip(weights, grads, moment, spread):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Network(classes, Chain(weights[0], weights[1]), Chain(weights[2], weights[3]), weights[4], weights[5])


def labelled_sample(
    docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang"
) -> DataFrame | None:
    """_text and _lang of about ``sample_rows`` documents of each language among the ``usable``."""
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = known.select("doc_id", F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    sizes = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    if not sizes:
        return None
    below = F.create_map(
        *[F.lit(v) for name, n in sorted(sizes.items()) for v in (name, int(min(1.0, 1.2 * sample_rows / n) * (1 << 30)))]
    )
    some = known.where(place("doc_id") < below[F.col("_lang")]).orderBy(place("doc_id"), "doc_id", "_text")
    return settle(some.limit(2 * sample_rows * len(sizes)).select("_text", "_lang"), "language-sample")


def training_pieces(sample: DataFrame | None) -> tuple[list[bytes], list[str]]:
    """Pieces of the documents of a ``labelled_sample``."""
    if sample is None:
        return [], []
    long = F.length("_text")
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(_PIECES - 1)),
        lambda i: F.substring("_text", F.lit(1) + F.floor(long * i / _PIECES).cast("int"), F.lit(WINDOW)),
    )
    rows = sample.select("_lang", spread.alias("pieces")).collect()
    pairs = [(p.encode(), r["_lang"]) for r in rows for p in r["pieces"] if p]
    return [p for p, _ in pairs], [v for _, v in pairs]


def fit(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Network:
    return train(*training_pieces(labelled_sample(docs, usable, sample_rows)))


# --------------------------------------------------------------------------
# prediction


def predict(
    docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
    into: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``keep``, and language and score of every row in the columns ``into``.

    Only the text goes to Python and only language and score come back; the rows stay in Spark.
    """
    names = list(into)

    def judged(column: pa.Array) -> pa.RecordBatch:
        raw = [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]
        spoken = np.array([bool(_LETTER.search(v.decode("utf-8", "replace"))) for v in raw], bool)
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in raw])]).astype(np.int64)
        if net.classes and len(raw) and offsets[-1]:
            p = net.pooled(np.frombuffer(b"".join(raw), np.uint8), offsets)
            best = p.argmax(axis=1)
            found = [net.classes[i] if s else UNKNOWN for i, s in zip(best, spoken)]
            score = np.where(spoken, np.clip(p[np.arange(len(p)), best], 0, 1), 1.0)
        else:
            found, score = [UNKNOWN] * len(raw), np.ones(len(raw))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(score, pa.float64())], names)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        schema = pa.schema([(names[0], pa.string()), (names[1], pa.float64())])
        for column in columns:
            whole = pa.RecordBatch.from_arrays([column], [text])
            parts = [judged(part.column(0)) for part in parts_of(iter([whole]))]
            yield pa.Table.from_batches(parts, schema).combine_chunks().to_struct_array().combine_chunks()

    schema = T.StructType([T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    # Not deterministic to the optimiser, so that no filter repeats it.
    pair = F.arrow_udf(run, schema).asNondeterministic()
    found = docs.select(*keep, pair(F.col(text)).alias("_judged"))
    return found.select(*keep, *[F.col("_judged")[c].alias(c) for c in into])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null id is one of them."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(True))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    net = fit(docs, ~held_out(F.col("doc_id")), sample_rows)
    out = predict(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def _share(text: Column) -> Column:
    """Letters among the characters that are not white space."""
    return _letters(text) / F.greatest(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(1))


def noise_pieces(pieces: list[bytes], seed: int = 17) -> list[bytes]:
    """For every piece one whose letters are drawn from those of all pieces, or some of them."""
    rng = np.random.default_rng(seed)
    texts = [p.decode("utf-8", "replace") for p in pieces]
    seen = sorted(set(_LETTER.findall("".join(texts))))
    low = [v for v in seen if v == v.lower()] or seen
    out = []
    for t in texts:
        among = low if rng.random() < 0.6 else seen
        if rng.random() < 0.5:
            among = rng.choice(among, max(1, len(among) // 2), replace=False)
        out.append(_LETTER.sub(lambda _: str(among[rng.integers(len(among))]), t).encode())
    return out


@dataclass(frozen=True)
class Limits:
    """``share``: of letters, which a text with a language reaches; ``score``: of ``und``,
    above which a long text has none."""

    share: float = 0.0
    score: float = 1.0

    def least_score(self, letters: Column) -> Column:
        return F.lit(1.0) - F.lit(1 - self.score) * letters / (letters + _FEW_LETTERS)


def fit_limits(sample: DataFrame, net: Network) -> Limits:
    """Limits from whole texts of a ``labelled_sample``, set so that clean texts stay: a third
    of the share that all but ``_UNUSUAL`` of them reach, and half way to 1 from the score of
    ``und`` that all but ``_UNUSUAL`` of them stay below (0.5 where that many are not ``und``)."""
    asked = sample.withColumn("_share", _share(F.col("_text")))
    rows = predict(asked, net, ("_share",), "_text").collect()
    share = float(np.quantile([r["_share"] for r in rows], _UNUSUAL, method="lower"))
    wrong = [r["score"] if r["lang_pred"] == UNKNOWN else 0.0 for r in rows]
    return Limits(share / 3, (1 + float(np.quantile(wrong, 1 - _UNUSUAL, method="lower"))) / 2)


@keeps_columns("doc_id", "text", "lang")
def spoken(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that have a language: a letter, and within the ``Limits``."""
    sample = labelled_sample(docs, ~held_out(F.col("doc_id")), sample_rows)
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if sample is None:
        return lettered
    pieces, labels = training_pieces(sample)
    noise = noise_pieces(pieces)[:: max(1, len(set(labels)))]
    net = train(pieces + noise, labels + [UNKNOWN] * len(noise))
    limits = fit_limits(sample, net)
    asked = lettered.where(_share(F.col("text")) >= limits.share).withColumn("_letters", _letters(F.col("text")))
    found = predict(asked, net, tuple(asked.columns), into=("_lang_pred", "_lang_score"))
    none = (F.col("_lang_pred") == UNKNOWN) & (F.col("_lang_score") >= limits.least_score(F.col("_letters")))
    return found.where(~none).drop("_lang_pred", "_lang_score", "_letters")
