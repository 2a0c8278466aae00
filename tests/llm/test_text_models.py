"""Quality rules, toxicity and language ID."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linklore.llm import language_id as L
from linklore.llm import quality_rules as Q
from linklore.llm import toxicity as X

from .data import documents, frame

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# -- quality rules


def plain_stats(text):
    words, n = (text or "").encode().split(), 0
    n = len(words)
    words = [w.decode() for w in words]
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside))


TEXTS = [None, "", "  \n\n ", "a b c a b c a b", "x\nx\n\n\nx y", "é漢😀 #*|<> $%&", "a a a a", "one\x1ctwo\x85three\xa0four",
         "word " * 5000, "a b c d " * 3 + "\n" + "a b c d " * 3, "\x0b\x0c\r\t"]


def test_stats_equal_plain_python(spark):
    rows = list(enumerate(TEXTS[:8] + TEXTS[9:])) + [(None, "a b"), (1, "")]
    got = Q.text_stats(frame(spark, rows)).collect()
    want = sorted(((i, *plain_stats(t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert Q.measure(TEXTS[8].encode())[4] == 5000


def test_many_kinds_of_words():
    rng = np.random.default_rng(0)
    words = [str(v).encode() for v in rng.integers(0, 300, 3000)]
    want = plain_stats(" ".join(w.decode() for w in words))[4]
    assert Q.repeated_words(words) == want


def test_list_finds_planted_rules_and_emits_them_in_order(spark):
    rng = np.random.default_rng(1)
    stats = rng.integers(60, 400, (2000, 5))
    stats[:, 1] = stats[:, 0] * 5
    stats[:, 2:] = 0
    bad = rng.random(2000) < 0.2
    stats[bad, 2] = stats[bad, 1] // 4
    rules = Q.learn_list(Q.feature_matrix(stats), bad)
    assert rules.rules and rules.rules[0].precision > 0.99
    df = spark.createDataFrame([tuple(map(int, r)) for r in stats[:300]], ", ".join(f"{s} bigint" for s in Q.STATS))
    got = [r[0] for r in df.select(rules.column()).collect()]
    assert [g > 0 for g in got] == [bool(b) for b in bad[:300]]


def test_no_rules_without_both_kinds(spark):
    x = Q.feature_matrix(np.full((50, 5), 100))
    assert Q.learn_list(x, np.zeros(50, bool)).rules == []
    docs, labels = frame(spark, [(0, "a " * 60)]), spark.createDataFrame([], "doc_id bigint, quality int")
    row = Q.judge(docs, Q.fit(docs, labels)).first()
    assert row["rule"] == 0 and row["base_failed"]
    assert Q.judge(frame(spark, []), Q.DecisionList()).count() == 0


def test_quality_of_the_table(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.judge(docs.withColumn("rule", F.lit("x")), Q.fit(docs, labels)).join(labels, "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


# -- toxicity


def test_scores_of_windows_equal_loops():
    weight = np.random.default_rng(2).standard_normal(X.BUCKETS).astype(np.float32)
    model = X.Model(weight, -0.5)
    texts = [b"Some words, (here) and there!", b"", b"   ", b"x", "é漢 ...".encode(), b"word " * 70_000, b"..,;"]
    alone = [max(model.word_logits(t.lower())[0], default=-np.inf) - 0.5 for t in texts]
    assert model.logits(texts) == pytest.approx(alone, abs=1e-3)


def test_held_out_toxicity_and_misspellings():
    rng = random.Random(7)
    syllables = ["th", "an", "re", "on", "ti", "er", "ou", "le", "mi", "sa"]
    clean = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(80))
    bad = ["grumpfish", "zapwicked", "blorkhead"]
    texts, toxic = [], []
    for i in range(900):
        words = clean().split()
        if i % 4 == 0:
            words[rng.randrange(80)] = rng.choice(bad)
        texts.append(" ".join(words).encode())
        toxic.append(int(i % 4 == 0))
    model = X.train(texts[:600], toxic[:600], steps=8000, whole=1200)
    called = model.logits(texts[600:]) >= 0
    assert np.mean(called == np.array(toxic[600:], bool)) >= 0.98
    other = [f"{clean()} {w} {clean()}".encode() for w in ("grumpfysh", "zapwickd", "blorkheaad", "grumpfishh")]
    assert (model.logits(other) >= 0).mean() >= 0.75


def test_toxicity_of_the_table_and_odd_rows(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    odd = frame(spark, [(None, "idiot"), (-1, None), (-2, ""), (-3, " \n ")])
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit(7))
    out = X.judge(both, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == docs.count() + 4
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["predicted"] == 0 and 0 <= by_id[i]["score"] < 0.5 for i in (-1, -2, -3))
    assert by_id[None]["held_out"]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got if r["doc_id"] is not None)
    clean = [by_id[r["doc_id"]]["predicted"] for r in labels.where("toxic = 0").collect()]
    assert np.mean(clean) <= 0.03
    assert X.score(frame(spark, []), X.train([], [])).count() == 0


def test_training_reads_whole_texts(spark, monkeypatch):
    rows = [(i, "clean " * 1400 + (f"grumpfish {i}" if i % 2 else f"end {i}")) for i in range(40)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    seen = {}
    monkeypatch.setattr(X, "train", lambda texts, toxic: seen.update(zip(texts, toxic)))
    X.fit(docs, labels)
    assert seen == {t.encode(): i % 2 for i, t in rows if crc(i) % 5}
    seen.clear()
    X.fit(docs, labels, sample_chars=40_000)
    whole = {t.encode() for _, t in rows}
    assert 4 <= len(seen) <= 8 and set(seen) <= whole and set(seen.values()) == {0, 1}


def test_bags_cover_every_segment():
    bucket, first = X._bags(b"word " * 500_000)
    assert len(first) == 500_001 and first[-1] == len(bucket)


# -- language ID


@pytest.fixture(scope="module")
def net(spark):
    return L.fit(documents(spark, SF), ~L.held_out(F.col("doc_id")), 120)


def test_held_out_accuracy(spark, net):
    rows = L.predict(documents(spark, SF), net, ("doc_id", "lang")).collect()
    held = [r for r in rows if crc(r["doc_id"]) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts(spark, net):
    rows = [(0, None), (1, ""), (2, "12 %%% 34\n"), (3, "²³ 😀"), (4, "the of and " * 20_000), (None, "the of and"), (5, "漢")]
    docs = frame(spark, rows).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(docs, net).collect()}
    assert all(got[i] == ("und", 1.0) for i in range(4))
    assert got[4][0] == got[None][0] == "en" and got[5][0] in net.classes


def test_windows_do_not_depend_on_neighbours(net):
    texts = [("the quick thtion of " * k).encode() for k in (1, 9, 40)]
    whole = net.pooled(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    alone = [net.pooled(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert whole == pytest.approx(np.array(alone), abs=1e-5)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    k, steps, n = 3, 5, 4
    chain = L.Chain(rng.standard_normal((3 * k, 256)), rng.standard_normal((3 * k, k)))
    x, given = rng.integers(0, 256, (steps, n)), rng.standard_normal((steps, k, n))
    states, kept = L._run(chain, x)
    d_in, d_loop = L._back(chain, x, kept, given)
    for array, grad, at in ((chain.loops, d_loop, (4, 1)), (chain.inputs, d_in, (2, x[1, 0])), (chain.loops, d_loop, (7, 2))):
        array[at] += 1e-3
        up = (L._run(chain, x)[0] * given).sum()
        array[at] -= 2e-3
        down = (L._run(chain, x)[0] * given).sum()
        array[at] += 1e-3
        assert grad[at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-2)
    fast = [h.copy() for h in L.Chain(chain.inputs.astype(np.float32), chain.loops.astype(np.float32)).states(x)]
    assert np.array(fast) == pytest.approx(states, abs=1e-4)


def test_without_labels_everything_is_und(spark):
    docs = frame(spark, [(0, "the and", None, "s"), (1, "x", None, "s")])
    assert {r["lang_pred"] for r in L.identify(docs).collect()} == {"und"}
    assert [r["doc_id"] for r in L.spoken(frame(spark, [(0, "the", None, "s"), (1, "12", None, "s")])).collect()] == [0]
    assert L.identify(frame(spark, []).withColumn("lang", F.lit("en"))).count() == 0


def test_network_and_letters_decide_what_is_spoken(spark):
    rng = random.Random(1)
    noise = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300))
    planted = [noise("abcdefghijklmnopqrstuvwxyz"), noise("bcdfghjklmnpqrstvwxz"), "%%% 12 34 56 q 77 88 " + "1 2 3 " * 200]
    docs = documents(spark, SF).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(planted)], docs.schema)
    got = {r["doc_id"] for r in L.spoken(docs.union(odd), 120).select("doc_id").collect()}
    assert not got & {-1, -2, -3}
    assert got == {r["doc_id"] for r in docs.collect()}
