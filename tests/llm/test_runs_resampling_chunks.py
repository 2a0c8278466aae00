"""Periodic runs, importance resampling and chunked BPE."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linklore.llm import chunk_bpe as B
from linklore.llm import periodic_runs as R
from linklore.llm import queries
from linklore.llm import resampling as S

from ..compare import difference, duck
from .data import DATA, documents, frame

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (5, "a b " * 400), (6, "é漢字 " * 900), (None, "no id " * 30), (7, "z" * 70_000)]


def with_clashes(df):
    """Extra columns with the names of results and of helpers."""
    for name in ("runs", "start", "segment", "run", "place", "rank", "score", "weight", "ids", "_words", "_b", "_n", "n_words"):
        df = df.withColumn(name, F.lit("extra"))
    return df


# -- periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, e - a, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng):
    n, k = rng.randint(0, 140), rng.choice([1, 2, 2, 3, 5, 50])
    words = [rng.randrange(k) for _ in range(n)]
    kind = rng.randrange(6)
    if kind == 0:  # no overlaps at all, many squares
        words = [bin(i).count("1") % 2 for i in range(n)]
    elif kind == 1:
        a, b = [1], [1, 2]
        while len(b) < n:
            a, b = b, b + a
        words = b[:n]
    elif kind == 2 and n > 4:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 2 + 1)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        words[rng.randrange(n)] = 99
    elif kind == 3:
        words = ([0] * rng.randint(1, 20) + [1]) * rng.randint(1, 9)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        texts = [odd_words(rng) for _ in range(20)]
        assert R.runs_of(texts) == [brute_runs(w) for w in texts]


def test_words_may_be_appended_one_by_one():
    rng = random.Random(4)
    for _ in range(25):
        words, catcher, at = odd_words(rng), R.SquareCatcher(), 0
        while at < len(words):
            step = rng.choice([1, 1, 3, 20])
            catcher.append(np.array(words[at : at + step]))
            at += step
        assert sorted((a, e - a, q) for a, e, q in catcher.finish()) == sorted(brute_runs(words))


def test_an_open_square_is_known_before_its_run_ends():
    catcher = R.SquareCatcher()
    for w in [9, 8, 7, 6, 5, 4, 3] * 2 + [9]:
        catcher.append(np.array([w]))
    assert [(q, a, e + q) for q, a, e in catcher.open] == [(7, 0, 15)]
    catcher.append(np.array([77]))
    assert catcher.runs == {(0, 15): 7}


def expected_report(doc_id, text):
    words = SPLIT.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda v: hashlib.sha256(v.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_run_report_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{w}" for w in odd_words(rng)) + rng.choice(["", "\n", " x"])) for i in range(300)] + ODD[:-1]
    got = R.report(with_clashes(frame(spark, rows)))
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected_report(*r) for r in rows), key=key)
    assert any(r["n_runs"] > 1 for r in got.collect())
    docs = documents(spark).where(F.length("text") < 4000)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in R.report(docs).collect():
        assert tuple(r) == expected_report(r["doc_id"], texts[r["doc_id"]])


def test_detected_runs_and_collapsed_text(spark):
    out = R.detect(frame(spark, [(1, "start " + "la li lu " * 5 + "end"), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in out[0]["runs"]] == [(1, 15, 3)] and out[0]["collapsed"] == "start la li lu end"
    assert out[1]["runs"] == [] and out[1]["collapsed"] == "" and out[1]["n_words"] == 0
    assert R.report(frame(spark, [(1, "a")]).limit(0)).collect() == []


# -- importance resampling


def brute_resample(docs, target, p):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(S.TERM, low)
        return words, [" ".join(words[i : i + n]) for n in range(1, p.longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for (x,) in target for f in features(x)[1])
    n_s, n_t, m = sum(s.values()), sum(t.values()), p.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + m) / ((s[b] + 1) * (n_t + m)))) for b in range(m)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words) >= p.least_words])
    enough = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(enough[: p.percent * len(enough) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("rows_a_segment", [4096, 7])
@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, monkeypatch, rows_a_segment, longest):
    monkeypatch.setattr(S, "_SEGMENT_ROWS", rows_a_segment)
    rng = random.Random(6)
    word = lambda: rng.choice(["Cat", "dog", "RUN", "été", "x1", "漢", "%"]) + rng.choice(["", ",", "-a"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(250)] + ODD
    docs += [(500, "same row again " * 9)] * 120  # a third of all rows is one row
    target = [("dog run cat " * 5,), (None,), ("",)]
    p = S.Resampling(longest=longest, percent=40)
    bench = with_clashes(spark.createDataFrame(target, "text string"))
    got = S.resample(with_clashes(frame(spark, docs)), bench, p).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, target, p)


def test_segments_stay_even_where_all_scores_are_equal(spark, monkeypatch):
    monkeypatch.setattr(S, "_SEGMENT_ROWS", 50)
    rows = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(5).cast("long").alias("score"))
    runs = S._sorted_runs(rows, 40)
    sizes = S._segmented(runs, S._splitters(runs, 40)).groupBy("segment").count().collect()
    assert len(sizes) == 40 and max(r["count"] for r in sizes) <= 2 * 50
    ranks = [r["rank"] for r in S.ranked(rows, 300, 2000).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 301)) and len(ranks) == 2000


def test_resampling_of_empty_tables(spark):
    none, some = frame(spark, [(1, "a")]).limit(0), frame(spark, [(1, "a b " * 20)] * 10)
    assert S.resample(none, some).collect() == []
    assert [r["rank"] for r in S.resample(some, none).collect() if r["rank"]] == [1]


def test_resampling_equals_sql(spark):
    for sf in (DATA, SF):
        df = queries.op12_importance_resampling(spark, sf)
        assert difference(df, duck(sf), queries.oracle_sql()["op12_importance_resampling"]) is None


# -- chunked BPE

PIECES = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "l", "<|endoftext|>", "<|endof", "text|>", "é", "漢", "字", "。", ".", "1"]
PIECES += ["23", "　", "\xa0", "🙂", "\x85", "\r\n", "hello", "-", "_", "é", "‍", "\x00"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_any_cuts_give_the_ids_of_the_library(library):
    coder, rng = B.ChunkCoder(TOKENIZER), random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 60)))
        cuts = [0, *sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 9)))), len(text)]
        chunks = [text[a:b].encode() for a, b in zip(cuts, cuts[1:]) if b > a]
        ids = coder.encode(chunks)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_every_entry_and_character_as_the_library(library):
    coder = B.ChunkCoder(TOKENIZER)
    texts = [b.decode("utf-8", "ignore") for b in coder.bytes_of]
    texts += ["a{0}1{0} {0}{0}b\n{0}. {0}'".format(chr(i)) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(texts), 4000):
        part = texts[at : at + 4000]
        for text, theirs in zip(part, library.encode_batch_fast(part, add_special_tokens=False)):
            assert coder.whole(text.encode()).tolist() == theirs.ids


def test_shared_passages_are_cut_alike_and_encoded_once():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    passage = prose(6000)
    texts = [f"{prose(50)} {passage} {prose(50)}" for _ in range(20)]
    cut = list(B.chunks_of([t.encode() for t in texts]))
    assert [b"".join(c).decode() for c in cut] == texts
    shared = set(cut[0]).intersection(*map(set, cut[1:]))
    assert sum(map(len, shared)) > 0.7 * len(passage)
    coder = B.ChunkCoder(TOKENIZER)
    for c in cut:
        coder.encode(c)
    assert coder.encoded < 0.4 * sum(map(len, texts))


def test_the_dictionary_is_bounded(library):
    coder, rng = B.ChunkCoder(TOKENIZER, remembered=30_000), random.Random(1)
    for _ in range(30):
        text = " ".join(str(rng.random()) for _ in range(2000))
        (ids,) = B.encode_texts(coder, [text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert coder.held <= 30_000 + 8 * B.LONGEST


@pytest.mark.parametrize("text", ["x" * 90_000, "漢" * 50_000, " " * 90_000, "ab" * 30_000 + " c", "\n \n" * 30_000])
def test_texts_without_sure_places(library, text):
    (ids,) = B.encode_texts(B.ChunkCoder(TOKENIZER), [text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_equals_the_library(spark, library):
    def expected(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda v: hashlib.sha256(v).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(back.encode())

    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = B.round_trip(documents(spark), TOKENIZER).collect()
    assert sorted(map(tuple, got)) == sorted(expected(*r) for r in rows)
    odd = B.round_trip(with_clashes(frame(spark, ODD)), TOKENIZER).collect()
    assert sorted(map(tuple, odd), key=repr) == sorted((expected(*r) for r in ODD), key=repr)
    assert B.round_trip(frame(spark, ODD).limit(0), TOKENIZER).collect() == []
    assert B.coded(frame(spark, [(1, "hello")]), TOKENIZER).first()["ids"] == library.encode("hello").ids


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        B.ChunkCoder(public_tokenizers.path("word_bpe_49k.json"))
