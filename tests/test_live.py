"""Windows, findings and epochs kept as state of a stream, against the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from linklore.operators import lifecycle as C
from linklore.operators import windows as W
from linklore.operators.timeline import timeline
from linklore.params import Params
from linklore.plans import catalog
from linklore.sources.session_files import envelopes_of, scan_sessions, to_recording, write_sessions
from linklore.streaming import epochs as E
from linklore.streaming import findings as FS
from linklore.streaming import windows as V

from .conftest import DATA, S, counters, dns, gateway, health, neighbor, wifi

P = Params(latency_span=12, trend_span=60, signal_lookback=20, density_lookback=24, throughput_span=8, cooldown=4, resolved_after=10)


def random_session(rng, name):
    """Events with ties in time, gaps, losses, changed identities and counters that fall."""
    out = {k: [] for k in ("gateway", "dns", "wifi", "scans", "counters", "health", "roams")}
    heard, at, rx = [], 0.0, 10_000
    for seq in range(rng.randint(40, 160)):
        at += rng.choice([0, 0, 0.5, 1, 1, 2, 3, 30])
        kind = rng.choice(["gateway"] * 4 + ["dns"] * 2 + ["wifi"] * 3 + ["scans"] * 2 + ["counters"] * 3 + ["health", "roams"])
        if kind == "gateway":
            out[kind].append(gateway(name, seq, at, rng.choice([4, 5, 6, 9, 60, 400]), rng.random() < 0.8, rng.choice(["gw", "gw2"])))
        elif kind == "dns":
            out[kind].append(dns(name, seq, at, rng.choice([20, 150, 400]), rng.random() < 0.6))
        elif kind == "wifi":
            ssid, bssid = rng.choice([("Home", "aa"), ("Home", "aa"), ("Home", None), (None, None), ("Cafe", "bb")])
            row = list(wifi(name, seq, at, rng.choice([-80, -72, -50]), ssid, bssid, rng.choice([1, 6, None])))
            row[6] = row[6] if rng.random() < 0.9 else None
            out[kind].append(tuple(row))
        elif kind == "scans":
            aps = [neighbor(name, seq, i, rng.choice([1, 1, 6, None]), rng.choice(["Home", "Cafe", None]), rng.choice(["aa", "bb", "cc", None]),
                            rng.choice([-80, -60, -40, None])) for i in range(rng.randint(0, 12))]
            out[kind].append((name, seq, int(at * S), "en0", len(aps)))
            heard += aps
        elif kind == "counters":
            rx = rng.choice([rx + 100, rx + 900_000, rx + 5, 50])
            out[kind].append(counters(name, seq, at, rx, rx // 3, rng.choice(["en0"] * 5 + ["en1"])))
        elif kind == "health":
            sensor, state = rng.choice([("wifi", "HardwareDisabled"), ("iface", "Stale"), ("wifi", "Operational"), ("dns", "Stale")])
            out[kind].append(health(name, seq, at, sensor, state))
        else:
            out[kind].append((name, seq, int(at * S), *[None] * 5))
    return out, heard


@pytest.fixture(scope="module")
def recorded(make):
    rng, streams, heard = random.Random(21), {}, []
    for i in range(8):
        rows, aps = random_session(rng, f"s{i}")
        heard += aps
        for name, found in rows.items():
            streams.setdefault(name, []).extend(found)
    return make(params=P, neighbors=heard, **streams)


def streamed(spark, path, build, schema, files=1):
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/feed")
    query = build(feed).writeStream.format("parquet").option("checkpointLocation", f"{path}/progress")
    query = query.trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows"), query.lastProgress["batchId"] + 1


def rows(df, columns):
    return sorted(repr(r.asDict(True)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("slices", [1, 5])
def test_live_windows_equal_the_timeline(spark, recorded, tmp_path, slices):
    events = V.window_events(recorded)
    events = events.unionByName(V.heartbeats(events, P))
    V.write_feed(events, f"{tmp_path}/feed", slices)
    got, batches = streamed(spark, tmp_path, lambda feed: V.timeline_stream(feed, P), events.schema)
    assert batches >= slices
    assert rows(got, got.columns) == rows(timeline(recorded), got.columns)


def test_live_findings_equal_the_batch_run(spark, recorded, tmp_path):
    events = V.window_events(recorded)
    events = events.unionByName(V.heartbeats(events, P))
    V.write_feed(events, f"{tmp_path}/feed", 6)
    got, _ = streamed(spark, tmp_path, lambda feed: FS.finding_stream(feed, P), events.schema)
    want = C.findings(recorded)
    assert rows(got, want.columns) == rows(want, want.columns)
    assert {r["lifecycle"] for r in got.collect()} >= {"Active", "Escalating", "Resolved"}
    assert got.select("kind").distinct().count() >= 5


def test_live_epochs_equal_the_batch_epochs(spark, recorded, tmp_path):
    events = V.window_events(recorded)
    V.write_feed(events, f"{tmp_path}/feed", 5)
    got, _ = streamed(spark, tmp_path, E.epoch_stream, events.schema)
    columns = ["session_id", "seq", "at_us", "lost", "epoch"]
    links = got.where(F.col("kind") == E.ASSOCIATION)
    assert rows(links, [*columns, "since_us", "identity_key"]) == rows(W.association_epochs(recorded), [*columns, "since_us", "identity_key"])
    meters = got.where(F.col("kind") == E.COUNTER)
    assert rows(meters, columns) == rows(W.counter_epochs(recorded), columns)


def test_a_seeded_query_goes_on_as_one_that_saw_everything(spark, recorded, tmp_path):
    events = V.window_events(recorded)
    whole = events.unionByName(V.heartbeats(events, P))
    cut = 70 * S
    past, rest = events.where(F.col("at_us") < cut), whole.where((F.col("at_us") >= cut) | (F.col("event_type") == V.HEARTBEAT))
    before = recorded.up_to(events.where(F.col("at_us") < cut).groupBy("session_id").agg(F.max("seq").alias("playhead_seq")))
    V.write_feed(rest, f"{tmp_path}/feed", 3)
    build = lambda feed: FS.finding_stream(feed, P, past=past, past_timeline=timeline(before))
    got, _ = streamed(spark, tmp_path, build, whole.schema)
    last = {r["session_id"]: r["last"] for r in past.groupBy("session_id").agg(F.max("at_us").alias("last")).collect()}
    want = [r for r in C.findings(recorded).collect() if (r["at_us"], r["is_tick"]) > (last[r["session_id"]], 0)]
    key = lambda r: repr(r.asDict(True))
    assert sorted(map(key, got.select(*want[0].asDict()).collect())) == sorted(map(key, want))
    assert any(r["lifecycle"] != "Active" and r["first_seen_us"] < cut for r in want)


def test_a_lone_silent_session_resolves_by_the_clock(spark, make, tmp_path):
    quick = Params(second_us=50_000, resolved_after=20)  # a second of the operators is 50 ms

    def probe(seq, at, ms):
        return ("lone", seq, at, *gateway("lone", seq, 0, ms)[3:])

    probes = [probe(i, i * 50_000, 5 if i % 3 else 300) for i in range(12)]
    events = V.window_events(make(params=quick, gateway=probes))
    V.write_feed(events, f"{tmp_path}/feed", 1)
    # The latest window keeps its rows, so the rule would fire for ever: end it with calm probes.
    calm = [probe(100 + i, 3_000_000 + i * 50_000, 5) for i in range(6)]
    V.write_feed(V.window_events(make(params=quick, gateway=calm)), f"{tmp_path}/feed", 1)
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    query = FS.finding_stream(feed, quick, quiet=0.2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress")
    query = query.trigger(processingTime="300 milliseconds").start(f"{tmp_path}/rows")
    try:
        until, told = time.time() + 60, []
        while time.time() < until and "Resolved" not in told:
            time.sleep(1)
            told = [r["lifecycle"] for r in spark.read.schema("lifecycle string").parquet(f"{tmp_path}/rows").collect()]
    finally:
        query.stop()
    assert "Active" in told and "Resolved" in told


def test_envelopes_give_the_same_events(spark, recorded, tmp_path):
    write_sessions(envelopes_of(recorded), f"{tmp_path}/files")
    found = scan_sessions(spark, f"{tmp_path}/files", by_folder=True).good()
    got = V.envelope_events(found).where(~F.col("event_type").isin("RoamDetected"))
    want = V.window_events(to_recording(found, params=P)).where(F.col("event_type") != "RoamDetected")
    columns = [c for c in want.columns if c != "neighbors"]
    assert rows(got, columns) == rows(want, columns)
    heard = lambda df: sorted(
        (r["session_id"], r["seq"], sorted(map(repr, r["neighbors"]))) for r in df.where("size(neighbors) > 0").collect()
    )
    assert heard(got) == heard(want)


def test_order_statistics_follow_arrival_and_eviction():
    rng, window, kept = random.Random(3), V.Latency(10), []
    for at in range(400):
        ok, ms = rng.random() < 0.8, float(rng.randint(1, 9))
        window.add(at // 3, ok, ms)
        kept = [r for r in [*kept, (at // 3, ok, ms)] if r[0] >= at // 3 - 10]
        good = sorted(m for _, o, m in kept if o)
        assert window.ordered == good and window.bad == sum(not o for _, o, _ in kept)
        assert window.median() == (good[len(good) // 2] if good else None)
        assert window.above(5.0) == sum(m > 5 for m in good)


def test_streamed_queries_run_in_a_session_without_the_state_store_setting(spark):
    key, plain = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    held, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, plain)
    try:
        assert catalog.queries()["stream_epochs"](spark, DATA).count() > 0
        assert spark.conf.get(key) == plain and spark.conf.get("spark.sql.shuffle.partitions") == parts
    finally:
        spark.conf.set(key, held)
