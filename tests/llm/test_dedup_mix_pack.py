"""MinHash near-dedup, source mixing, packing, fixity, licences, and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from linklore.llm import components as C
from linklore.llm import fixity, license_rules, mixing, packing, queries, tokens
from linklore.llm import minhash_dedup as H
from linklore.llm import blocks

from ..compare import difference, duck
from .data import DATA, documents, frame

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# -- near-duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    above = {i: i for i in sets}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def chained_copies(seed, groups=12):
    """Groups in which each text is an edit of another, so that similarities are mixed."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(groups):
        group = [rng.choices(words, k=rng.randint(5, 150))]
        for _ in range(rng.randint(0, 25)):
            t = list(rng.choice(group))
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            group.append(t)
        texts += [" ".join(t) for t in group]
    rng.shuffle(texts)
    return list(enumerate(texts))


def dedup(df, p=H.Banding()):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in H.near_duplicates(df, p).collect()}


def test_components_equal_brute_force(spark):
    rows = chained_copies(3)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "Two words"), (1004, "two  WORDS"), (1005, "two word"),
           (1006, "É a b c d"), (1007, "é a b c d"), (1008, "x " * 50_000), (1009, "X " * 50_001)]
    assert dedup(frame(spark, rows + odd)) == brute(rows + odd)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    rows = chained_copies(8, 5)
    assert dedup(frame(spark, rows)) == brute(rows)


def test_repeated_ids_nulls_and_empty_tables(spark):
    text = "one two three four five six seven"
    got = [tuple(r) for r in H.near_duplicates(frame(spark, [(5, text), (5, text), (None, text), (7, text), (8, None)])).drop("text_hash").collect()]
    assert Counter(got) == Counter({(5, 3, 5, True): 2, (None, 3, None, True): 1, (7, 3, 5, False): 1, (8, 0, 8, True): 1})
    assert H.near_duplicates(frame(spark, [])).count() == 0
    kept = H.deduplicated(frame(spark, [(5, text), (5, text), (None, text), (None, text), (7, text)]).withColumn("kept", F.lit(1)))
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["5", "None", "None"] and "kept" in kept.columns


def test_components_on_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 240)] + [(300, 300), (400, 401), (401, 400)]
    rng.shuffle(edges)
    got = {r["node"]: r["component_id"] for r in C.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 240)}, 400: 400, 401: 400}
    assert C.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# -- mixing


def fill(sizes):
    """Targets of sizes in order of their sources, by raising the level step by step."""
    weight = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    most, free, target = [2.0 * s for s in sizes], set(range(len(sizes))), {}
    left = 1.5 * sum(sizes)
    while free:
        level = left / sum(weight[i] for i in free)
        over = {i for i in free if level * weight[i] > most[i]}
        if not over:
            target.update({i: level * weight[i] for i in free})
            break
        target.update({i: most[i] for i in over})
        left -= sum(most[i] for i in over)
        free -= over
    return [target[i] for i in range(len(sizes))]


def test_mix_of_the_table(spark):
    rows = mixing.mix(documents(spark, SF)).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    by_source = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode().split())
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 2
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source)
    want = fill([sum(r["size"] for r in by_source[n]) for n in names])
    for name, target in zip(names, want):
        group = by_source[name]
        assert group[0]["target"] == pytest.approx(target)
        assert sum(r["taken"] for r in group) == pytest.approx(target, rel=0.01)
        expected = target / group[0]["source_size"] * len(group)
        assert abs(sum(r["times"] for r in group) - expected) <= max(4, 0.08 * len(group))
    again = mixing.mix(documents(spark, SF).repartition(7)).select("doc_id", "times").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["times"]) for r in rows)


def test_many_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 32)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), "en", rng.choice(["a", "b", None, "ä"])) for i in range(900)]
    rows += [(900, None, "en", "a"), (901, "", "en", None), (902, " ", "en", "only empty")] + [(903, "x y", "en", "b")] * 40 + [(None, "q", "en", None)]
    docs = frame(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    names = ["a", "b", "only empty", "ä", None]
    group = {n: [r for r in got if r["source"] == n] for n in names}
    want = fill([sum(r["size"] for r in group[n]) for n in names])
    for n, t in zip(names, want):
        assert group[n][0]["target"] == pytest.approx(t)
        assert sum(r["taken"] for r in group[n]) == pytest.approx(t, rel=0.01, abs=2)
    times = Counter(r["doc_id"] for r in got for _ in range(r["times"]))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == times
    assert mixing.mix(frame(spark, []).select("doc_id", "text", F.lit("s").alias("source"))).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    size, p = rng.integers(1, 900, 500).astype(float), rng.random(500)
    q = mixing.flight(p, size, rng)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)
    done = mixing.landing(p, size, rng)
    assert set(done) <= {0.0, 1.0} and abs(done @ size - p @ size) < 5


# -- packing


def check_packing(rows, got, sequence=2048):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc_id, text in rows:
        want[(doc_id, len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1)] += 1
    total = Counter()
    for r in got:
        total[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert total == Counter({k: k[1] * n for k, n in want.items()})
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    for r in got:
        crcs = {zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for ids in texts[r["doc_id"]]}
        assert r["ids_crc32"] in crcs
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= sequence


def test_packing_of_the_table(spark):
    docs = documents(spark)
    got = packing.pack(docs, TOKENIZER).collect()
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    used = sum(r["length"] for r in got)
    assert used >= 0.97 * 2048 * len({r["sequence_id"] for r in got})


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "_PART_ROWS", 3)
    rows = [(0, None), (1, ""), (2, "<|startoftext|> İß ﬁ 漢字 'S don't 12³"), (3, "a\x1cb\x85c\xa0d"), (4, "the " * 9000)]
    rows += [(5, "same text")] * 30 + [(None, "no id")]
    docs = frame(spark, rows).withColumn("length", F.lit("clash"))
    check_packing(rows, packing.pack(docs, TOKENIZER).collect())
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


def test_patterns_place_every_length():
    rng = np.random.default_rng(6)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 60), rng.integers(1, 10**9, 60))}
    patterns = packing.shortest_pack_first(counts, 100)
    placed = Counter()
    for many, lengths in patterns:
        assert sum(lengths) <= 100 and list(lengths) == sorted(lengths, reverse=True)
        for n in lengths:
            placed[n] += many
    assert placed == Counter(counts) and len(patterns) < 4000


# -- fixity and licences


@pytest.mark.parametrize("name", ["op1_warc_fixity", "op5_license_rules"])
def test_query_equals_sql(spark, name):
    assert difference(queries.queries()[name](spark, DATA), duck(DATA), queries.oracle_sql()[name]) is None


def book(spark, rows):
    return fixity.ledger(spark.createDataFrame(rows, "archive_id bigint, record_id bigint, payload string"))


def test_audit_names_each_kind_of_damage(spark):
    rows = [(a, i, f"payload {a} {i} " + "x" * (i % 7)) for a in (1, 2, 3) for i in range(300)] + [(3, 5, "again"), (4, None, None)]
    copy = [(a, i, p) for a, i, p in rows if (a, i) != (2, 299)]
    copy[17] = (1, 17, "PAYLOAD 1 17 xxx")
    copy.append((3, 999, "extra"))
    roots, damaged = fixity.audit(book(spark, rows), book(spark, copy))
    same = {r["archive_id"]: r["root_a"] == r["root_b"] for r in roots.collect()}
    assert same == {1: False, 2: False, 3: False, 4: True}
    assert {(r["archive_id"], r["record_id"], r["status"]) for r in damaged.collect()} == {
        (1, 17, "changed"), (2, 299, "missing"), (3, 999, "extra")}
    roots, damaged = fixity.audit(book(spark, rows), book(spark, rows[:10] + rows[11:]))
    found = Counter(r["status"] for r in damaged.where("archive_id = 1").collect())
    assert found == {"missing": 1, "moved": 289}
    roots, damaged = fixity.audit(book(spark, []), book(spark, []))
    assert roots.count() == damaged.count() == 0


def test_pages_with_nulls_and_repeats(spark):
    rows = [(1, "u", "<a>"), (1, "u", "<a>"), (None, None, None), (3, None, ""), (2048, "v", "é" * 10_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    got = fixity.audit_pages(pages).where("record_id is null and status in ('intact', 'damaged')").collect()
    assert sum(r["extent"] for r in got) == len(rows)


def test_licence_rules(spark):
    mit = license_rules.SENTENCES["mit-permission"]
    rows = [
        (0, None), (1, ""), (2, "no licence here."), (3, "Body text\nLicensed under CC BY-NC 4.0.\nmore"),
        (4, "Licensed under the Apache License,\n   Version 2.0. You may not use this file except in compliance with the License. "
            "You may obtain a copy of the License at"),
        (5, f"The MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}: The above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software."),
        (6, "All rights reserved.\nAll rights reserved.\nReleased under the MIT License."), (7, "x " * 50_000 + "\nAll Rights Reserved."),
        (8, "// SPDX-License-Identifier: MIT"), (9, "Copyright 2021 Acme. All rights reserved."),
    ]
    docs = frame(spark, rows + [(None, "Released under the MIT Licence.")]).withColumn("licenses", F.lit(1))
    got = {r["doc_id"]: r["licenses"] for r in license_rules.recognise(docs).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "CC-BY-NC-4.0", 4: "Apache-2.0", 5: "MIT", 6: "MIT,Proprietary", 7: "Proprietary",
                   8: "MIT", 9: "Proprietary", None: "MIT"}
    assert license_rules.recognise(frame(spark, [])).count() == 0


def test_full_licence_texts(spark):
    met = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    source = "Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
    binary = ("Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following "
              "disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n")  # fmt: skip
    neither = ("Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products "
               "derived from\n   this software without specific prior written permission.\n\n")  # fmt: skip
    notice = "Copyright (c) 2020, Some One. All rights reserved.\n\n"
    as_is = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "AS IS".\n'
    mit = ("MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
           'of this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including '
           "without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, "
           "and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright "
           "notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n")  # fmt: skip
    apache = ('Copyright 2020 J. Smith. All rights reserved.\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this '
              "file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n")  # fmt: skip
    cases = [
        (f"{notice}{met}1. {source}2. {binary}{as_is}", "BSD-2-Clause"), (f"{notice}{met}1. {source}2. {binary}3. {neither}{as_is}", "BSD-3-Clause"),
        (f"{notice}{met}* {source}* {binary}* {neither}{as_is}", "BSD-3-Clause"), (f"{met}(a) {source}(b) {binary}(c) {neither}", "BSD-3-Clause"),
        (mit, "MIT"), (apache, "Apache-2.0"), ("Apache License\nVersion 2.0, January 2004\n", "Apache-2.0"),
        ("This project is licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This software is released under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("This project is licensed under the MIT License - see the LICENSE file", "MIT"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later"), ("Distributed under the GNU General Public License v3.0.", "GPL-3.0"),
        ("Copyright 2020 J. Smith. All rights reserved.", "Proprietary"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in license_rules.recognise(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


NAMED = [
    ("This project is released under ISC.", "ISC"), ("Distributed under Apache 2.0.", "Apache-2.0"), ("Available under CC BY 4.0.", "CC-BY-4.0"),
    ("This code is available under the terms of the GPLv3.", "GPL-3.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("/* SPDX-License-Identifier: Apache-2.0 OR MIT */", "Apache-2.0,MIT"), ("Licensed under the LGPL 2.1.", "LGPL-2.1"),
    ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0"),
    ("Dual licensed under the MIT license or the Apache License, Version 2.0, at your option.", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: (MIT AND BSD-3-Clause)", "MIT,BSD-3-Clause"), ("SPDX-License-Identifier: Foo-1.0 OR MIT", "MIT"),
    ("This library is distributed under the GNU Lesser General Public License v2.1 or later.", "LGPL-2.1-or-later"),
    ("All rights reserved.", "Proprietary"), ("Copyright 2020 A. All rights reserved.\n\nLicensed under the MIT License.", "MIT"),
    ("no rights here", ""), ("The show is available under water.", ""), ("Released under the\nMIT licence.", "MIT"),
    ("1. The MIT License\n2. Licensed under CC BY-NC-SA 4.0", "MIT,CC-BY-NC-SA-4.0"), ("Licensed under the MIT and Zlib licenses.", "MIT,Zlib"),
    ("Provided\n\tunder the ISC license.", "ISC"), (None, ""), ("", ""), ("neither the name of X.", ""), ("Version 2.0, January 2004", ""),
]


def test_names_expressions_and_sql_agree(spark):
    import duckdb
    import pyarrow as pa

    texts = [t for t, _ in NAMED] + ["x " * 50_000 + "\nDistributed under Apache 2.0."]
    found = {tuple(r) for r in license_rules.recognise(frame(spark, list(enumerate(texts)))).collect()}
    by_id = {r[0]: r[3] for r in found}
    assert [set(by_id[i].split(",")) for i in range(len(NAMED))] == [set(want.split(",")) for _, want in NAMED]
    assert by_id[len(NAMED)] == "Apache-2.0"
    with duckdb.connect() as con:
        con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
        assert set(con.execute(license_rules.recognise_sql()).fetchall()) == found


def test_every_known_sentence_holds_a_marker():
    import re

    marker = re.compile(license_rules.MARKERS)
    assert all(marker.search(s) for s in license_rules.SENTENCES.values())
    patterns = [re.sub(r"[\^$?]|\(.*?\)", "", p) for _, p in license_rules.PATTERNS]
    assert all(marker.search(p) for p in patterns if not p.startswith(("nor", " [0-9]")))
    leads = ("released", "distributed", "published", "provided", "made available", "available", "licensed", "dual licensed")
    names = {n for all_ in license_rules.NAMES.values() for n in all_}
    assert all(marker.search(f"{lead} under the {n}") and re.match(license_rules.LEAD, f"{lead} under the {n}") for lead in leads for n in names)
    known = {*license_rules.SENTENCES, *(n for n, _ in license_rules.PATTERNS)}
    assert {i for _, ids in license_rules.RULES + license_rules.FIRST_RULES for i in ids} <= known


def test_a_name_stands_for_one_licence():
    import re

    names = [n for all_ in license_rules.NAMES.values() for n in all_]
    assert len(names) == len(set(names))
    assert all(re.sub(license_rules._AROUND, "", n) == n for n in names)


# -- the pipeline


def test_pipeline_stage_by_stage(spark):
    docs = documents(spark)
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "secret_scan", "source_mixing", "packing"]
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 34", "en", None, 5),
                                 (9004, 'some words token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" more', "en", None, 60)], docs.schema)
    docs, stages = docs.union(odd), dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, DATA)
    assert spoken.columns == names and spoken.count() == docs.count() - 3
    single = stages["minhash_dedup"](spark, spoken, DATA)
    want = brute([(r["doc_id"], r["text"]) for r in spoken.collect()])
    assert {r["doc_id"] for r in single.collect()} == {i for i, v in want.items() if v[2]}
    masked = stages["secret_scan"](spark, single, DATA)
    assert masked.columns == names and masked.count() == single.count()
    text = masked.where("doc_id = 9004").first()
    assert text["text"] == 'some words [SECRET]" more' and text["n_chars"] == len(text["text"])
    mixed = stages["source_mixing"](spark, masked, DATA)
    assert mixed.columns == names
    assert 0 <= mixed.count() <= 2 * masked.count()


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert got and {"doc_id", "sequence_id", "offset"} <= set(got[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None


PRIVATE = ("_id _h _nth _copy _times _time _base _all _tokens _free _letters _lang_pred _lang_score _share _text _lang _other0 "
           "_other1 spans size kept length p score a.b").split()  # fmt: skip


@pytest.mark.parametrize("stage", ["language_id", "minhash_dedup", "secret_scan", "source_mixing"])
def test_stages_keep_columns_of_any_name(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = documents(spark).where("doc_id < 80")
    clashing = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in PRIVATE])
    rows = run(spark, clashing, DATA)
    assert rows.columns == clashing.columns
    found = rows.collect()
    assert found and all(r[n] == f"{n}{r['doc_id']}" for r in found for n in PRIVATE)
    expected = Counter(map(tuple, run(spark, plain, DATA).collect()))
    assert Counter(tuple(r)[: len(plain.columns)] for r in found) == expected


def test_stages_of_an_empty_table(spark):
    docs = documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.collect() == []
        if name != "packing":
            assert out.columns == docs.columns


# -- words of the packing tokenizer


def test_ids_of_odd_texts_equal_the_library():
    encoder = tokens.WordEncoder(TOKENIZER)
    library, rng = Tokenizer.from_file(TOKENIZER), random.Random(1)
    marks = list("abcdefghijklmnopqrstuvwxyz '' 1") * 8 + ["<|endoftext|>", "<|", "漢", "🙂", "ﬁ", "Σ", "̇"]
    letters = [chr(i) for i in range(0x250)] + marks
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(6000)]
    texts += [t.removesuffix("</w>") + tail for t in library.get_vocab() for tail in ("", " x")]
    texts += ["", " ", "\x01", "x" * 60_000, "ab " * 30_000]
    for at in range(0, len(texts), 4000):
        part = texts[at : at + 4000]
        for ids, theirs in zip(encoder.encode(part), library.encode_batch_fast(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == theirs.ids
