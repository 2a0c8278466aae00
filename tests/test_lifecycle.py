"""Lifecycle against a step-by-step model on random sessions, both layouts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linklore.operators import lifecycle as C
from linklore.operators import timeline as TL
from linklore.params import Params
from linklore.plans.sequence import WHOLE, Layout

from .conftest import counters, dns, gateway, neighbor, wifi

S = 1_000_000
CAND = (
    "session_id string, at_us bigint, is_tick int, seq bigint, kind string, fingerprint string, "
    "confidence float, numbers array<double>, words array<string>"
)
INST = "session_id string, at_us bigint, is_tick int, seq bigint"


def model(steps, p):
    """Transitions of one session: steps are (at_us, {fingerprint: confidence})."""
    live, out = {}, []
    for at, seen in steps:
        for name, c in seen.items():
            c = np.float32(c)
            if name not in live:
                live[name] = dict(first=at, seen=at, emit=at, shown=c, peak=c)
                out.append((at, name, "Active", float(c), float(c), at))
                continue
            f = live[name]
            f["seen"], f["peak"] = at, max(f["peak"], c)
            change = c - f["shown"]
            if abs(change) >= np.float32(p.material_delta) and at - f["emit"] >= p.cooldown * S:
                word = "Escalating" if change > 0 else "Recovering"
                out.append((at, name, word, float(c), float(f["peak"]), f["first"]))
                f["emit"], f["shown"] = at, c
        for name in [n for n in live if n not in seen]:
            if at - live[name]["seen"] >= p.resolved_after * S:
                f = live.pop(name)
                out.append((at, name, "Resolved", 0.0, float(f["peak"]), f["first"]))
    return sorted(out)


def sessions(seed, n):
    rng = random.Random(seed)
    data = {}
    for s in range(n):
        at, steps, on = 0, [], {}
        for _ in range(rng.randint(20, 120)):
            at += rng.choice([1, 2, 2, 5, 15, 20, 30]) * S
            for name in ("x", "y"):
                if rng.random() < 0.25:
                    on[name] = not on.get(name, False)
            seen = {k: round(rng.choice([0.3, 0.45, 0.5, 0.6, 0.65, 0.8]), 2) for k, v in on.items() if v}
            steps.append((at, seen))
        data[f"s{s}"] = steps
    return data


def frames(spark, data):
    cand, inst = [], []
    for s, steps in data.items():
        for i, (at, seen) in enumerate(steps):
            inst.append((s, at, 0, i))
            cand += [(s, at, 0, i, "K", name, c, [c], [name]) for name, c in seen.items()]
    return spark.createDataFrame(cand, CAND), spark.createDataFrame(inst, INST)


@pytest.mark.parametrize("layout", [WHOLE, Layout(10, 40 * S), Layout(10, 7 * S)])
def test_random_sessions(spark, layout):
    p = Params()
    data = sessions(11, 40)
    cand, inst = frames(spark, data)
    got = C.transitions(cand, inst, p, layout).collect()
    for s, steps in data.items():
        mine = sorted(
            (r.at_us, r.fingerprint, r.lifecycle, r.confidence, r.peak_confidence, r.first_seen_us)
            for r in got
            if r.session_id == s
        )
        assert mine == model(steps, p), s


def test_cooldown_and_short_flicker(spark):
    data = {
        "cool": [(0, {"x": 0.5}), (5 * S, {"x": 0.8}), (15 * S, {"x": 0.8})],
        "flicker": [(0, {"x": 0.5}), (10 * S, {}), (11 * S, {"x": 0.5}), (30 * S, {})],
        "jitter": [(0, {"x": 0.5}), (20 * S, {"x": 0.55})],
    }
    cand, inst = frames(spark, data)
    rows = C.transitions(cand, inst, Params(), WHOLE).orderBy("at_us").collect()
    words = {s: [r.lifecycle for r in rows if r.session_id == s] for s in data}
    assert words == {"cool": ["Active", "Escalating"], "flicker": ["Active"], "jitter": ["Active"]}


def test_resolved_text_and_active_set(spark):
    data = {"a": [(0, {"x": 0.7, "y": 0.4}), (25 * S, {"y": 0.4})]}
    cand, inst = frames(spark, data)
    found = C.transitions(cand, inst, Params(), WHOLE)
    gone = found.where("lifecycle = 'Resolved'").first()
    assert (gone.fingerprint, gone.confidence, gone.last_seen_us, gone.words) == ("x", 0.0, 25 * S, ["x"])
    assert [r.fingerprint for r in C.active_findings(found).collect()] == ["y"]


def test_stream_equals_batch(spark, tmp_path):
    from linklore.streaming.lifecycle import evaluations, finding_stream

    p = Params()
    data = sessions(5, 12)
    cand, inst = frames(spark, data)
    rows = evaluations(cand, inst)
    # Micro-batches in time order: early steps first.
    for i, cut in enumerate([(0, 400 * S), (400 * S, 10**15)]):
        part = rows.where((F.col("at_us") >= cut[0]) & (F.col("at_us") < cut[1]))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        .withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "1 hour")
    )
    query = (
        finding_stream(live, p).writeStream.format("memory").queryName("live_findings")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.table("live_findings").collect()
    for s, steps in data.items():
        mine = sorted(
            (r.at_us, r.fingerprint, r.lifecycle, r.confidence, r.peak_confidence, r.first_seen_us)
            for r in got if r.session_id == s
        )
        assert mine == model(steps, p), s


def silent_sessions(seed, n):
    """Bursts of events with silences from seconds to a day between them."""
    rng = random.Random(seed)
    rows = {k: [] for k in ("gateway", "dns", "wifi", "scans", "counters")}
    heard = []
    for s in range(n):
        name, at, total = f"s{s}", rng.choice([0, 1.7, 1_700_000_000.25]), 0
        for seq in range(rng.randint(30, 60)):
            at += rng.choice([0, 1, 1, 2, 3, 7, 20] if rng.random() < 0.8 else [100, 139, 160, 288, 290, 450, 3600, 86_400])
            kind = rng.choice(list(rows))
            if kind == "gateway":
                rows[kind].append(gateway(name, seq, at, rng.choice([5, 5, 80]), rng.random() < 0.7))
            elif kind == "dns":
                rows[kind].append(dns(name, seq, at, rng.choice([20, 400]), rng.random() < 0.6))
            elif kind == "wifi":
                rows[kind].append(wifi(name, seq, at, rng.choice([-50, -72, -85])))
            elif kind == "counters":
                total += rng.choice([0, 10_000_000])
                rows[kind].append(counters(name, seq, at, total))
            else:
                size = rng.choice([2, 9, 16])
                rows[kind].append((name, seq, int(at * S), "en0", size))
                heard += [neighbor(name, seq, i, 11, "Home", f"b{i}", -55) for i in range(size)]
    return rows, heard


@pytest.mark.parametrize("layout", [WHOLE, Layout(12, 600 * S)])
def test_ticks_of_a_silence_change_nothing(make, layout):
    rows, heard = silent_sessions(3, 14)
    rec = make(layout=layout, neighbors=heard, **rows)
    every = C.findings(rec, every_tick=True) if layout is WHOLE else C.findings(make(neighbors=heard, **rows), every_tick=True)
    few = C.findings(rec)
    assert sorted(map(str, few.collect())) == sorted(map(str, every.collect()))
    assert every.select("kind").distinct().count() >= 5
    if layout is WHOLE:
        assert TL.ticks(rec, every=False).count() < TL.ticks(rec).count() / 10
        assert TL.ticks(rec, every=False).exceptAll(TL.ticks(rec)).count() == 0


def test_ticks_grow_with_events_not_with_time(make):
    year = 365 * 86_400
    rec = make(gateway=[gateway("a", i, i * year / 9, 5) for i in range(10)])
    slot = TL.quiet_span(rec.params) // rec.params.tick
    assert TL.ticks(rec, every=False).count() <= 3 * 10 * slot
    assert TL.ticks(make(gateway=[gateway("a", 0, 5, 5)]), every=False).count() == TL.ticks(
        make(gateway=[gateway("a", 0, 5, 5)])
    ).count()


def test_playheads_see_the_same_findings_where_times_go_back(spark, make):
    """Times that run against the order of the log, rows without a time and sessions of one row."""
    rng = random.Random(5)
    rows = {"gateway": [], "dns": [], "wifi": [], "counters": []}
    for s in ("a", "b", "c"):
        for seq in range(260 if s != "c" else 1):
            at = seq * 2 + rng.choice([0, 0, 0, -25, 30])
            kind = rng.choice(list(rows))
            if kind == "gateway":
                row = gateway(s, seq, at, rng.choice([5, 6, 90]), rng.random() < 0.8)
            elif kind == "dns":
                row = dns(s, seq, at, 20, rng.random() < 0.6)
            elif kind == "wifi":
                row = wifi(s, seq, at, rng.choice([-50, -60, -80]))
            else:
                row = counters(s, seq, at, seq * rng.choice([10, 100_000]))
            rows[kind].append((*row[:2], None, *row[3:]) if rng.random() < 0.01 else row)
    rec = make(**rows)
    ends = "session_id string, playhead_seq bigint, playhead_us bigint"
    heads = spark.createDataFrame([("a", 130, 250 * S), ("b", 60, 118 * S), ("c", 0, 0)], ends)
    seen = rec.seen_by(heads)
    assert seen.log().count() < rec.log().count()
    whole, cut = (
        C.findings(r).join(heads, "session_id").where("at_us <= playhead_us").collect() for r in (rec, seen)
    )
    assert whole and sorted(map(repr, whole)) == sorted(map(repr, cut))
