"""Session files: every error kind, numbering across splits, round trip, tail."""

import json

import pytest
from pyspark.sql import functions as F

from linklore.operators import summary as SM
from linklore.plans.sequence import Layout
from linklore.sources import session_files as SF
from linklore.sources.recording import ORIGIN
from linklore.streaming import tail as TAIL

from .conftest import counters, dns, gateway, health, neighbor, wifi

HEADER = {
    "row": "header", "kind": "network-session", "format_version": 2,
    "created_at": "2026-05-28T19:23:13.381101Z", "tool_version": "0.1.0", "future": {"x": 1},
}


def row(i, at=None, **event):
    event = event or {
        "type": "GatewayLatency", "target": "10.0.0.1", "rtt": {"secs": 0, "nanos": 7_000_000},
        "reachable": True, "probe": "icmp",
    }
    at = at or f"2026-05-28T19:23:{i % 60:02d}.123456789Z"
    return {"row": "envelope", "id": i, "at": at, "source": "gateway", "event": event}


def put(folder, name, lines):
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    (folder / name).write_text(text + ("\n" if text else ""))


def by_name(df):
    return {r.session_id.rsplit("/", 1)[1]: r for r in df.collect()}


def test_header_status(spark, tmp_path):
    put(tmp_path, "ok", ["", HEADER, row(1)])
    put(tmp_path, "empty", [])
    put(tmp_path, "blank", ["", "  "])
    put(tmp_path, "headless", [row(1)])
    put(tmp_path, "text", ["hello"])
    put(tmp_path, "kind", [{**HEADER, "kind": "other", "created_at": [1]}])
    put(tmp_path, "newer", [{**HEADER, "format_version": 3, "created_at": [1]}])
    put(tmp_path, "older", [{**HEADER, "format_version": 1, "created_at": [2023, 318, 22, 13, 20, 0, 0, 0, 0]}])
    put(tmp_path, "shape", [{**HEADER, "created_at": 5}])
    got = {k: r.status for k, r in by_name(SF.scan_sessions(spark, str(tmp_path)).sessions).items()}
    assert got == {
        "ok": "ok", "empty": "Empty", "blank": "Empty", "headless": "MissingHeader", "text": "BadJson",
        "kind": "WrongKind", "newer": "NewerVersion", "older": "OlderVersion", "shape": "BadJson",
    }


def test_row_errors_and_policies(spark, tmp_path):
    put(tmp_path, "bad", [HEADER, row(1), "", "{oops", row(2)])
    put(tmp_path, "twice", [HEADER, row(1), HEADER, row(2)])
    put(tmp_path, "lacking", [HEADER, row(1), row(2, type="SensorHealth", sensor="wifi"), row(3)])
    put(tmp_path, "unknown", [HEADER, row(1, type="Mystery")])
    put(tmp_path, "good", [HEADER, row(1), row(2)])
    read = SF.scan_sessions(spark, str(tmp_path))
    bad = {k: (r.line, r.error) for k, r in by_name(read.first_errors()).items()}
    assert bad == {
        "bad": (4, "BadJson"), "twice": (3, "DuplicateHeader"), "lacking": (3, "BadJson"), "unknown": (2, "BadJson"),
    }

    def counts(policy):
        rec = SF.read_sessions(spark, str(tmp_path), on_error=policy)
        return {k: r.envelope_count for k, r in by_name(SM.session_summary(rec)).items()}

    assert counts("truncate") == {"bad": 1, "twice": 1, "lacking": 1, "good": 2}
    assert counts("quarantine") == {"bad": 2, "twice": 2, "lacking": 2, "good": 2}
    with pytest.raises(SF.SessionError, match="DuplicateHeader in .*twice, line 3"):
        SF.read_sessions(spark, str(tmp_path / "twice"))
    with pytest.raises(SF.SessionError, match="BadJson in .*bad, line 4"):
        SF.read_sessions(spark, str(tmp_path / "bad"))
    landed = f"{tmp_path}-landed"
    SF.land(SF.scan_sessions(spark, str(tmp_path / "bad")), landed)
    with pytest.raises(SF.SessionError, match="BadJson in .*bad"):
        SF.read_landed(spark, landed).strict()
    put(tmp_path, "none", [])
    with pytest.raises(SF.SessionError, match="none: Empty"):
        SF.read_sessions(spark, str(tmp_path))
    assert SF.read_sessions(spark, str(tmp_path / "good")).gateway.count() == 2


def test_line_numbers_do_not_depend_on_file_splits(spark, tmp_path):
    put(tmp_path, "long", [HEADER, *[row(i) for i in range(1, 1500)], "{bad"])
    put(tmp_path, "short", [HEADER, row(1), "{bad"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        read = SF.scan_sessions(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        rows = read.good().where("session_id like '%long'").orderBy("seq").select("seq", "id").collect()
        bad = {k: r.line for k, r in by_name(read.first_errors()).items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.id for r in rows] == list(range(1, 1500)) and len({r.seq for r in rows}) == 1499
    assert bad == {"long": 1501, "short": 3}


def test_repeated_ids_are_read_once_and_times_have_two_forms(spark, tmp_path):
    finding = dict(
        type="Finding", kind="DnsPathology", fingerprint="dns_pathology", headline="h", confidence=0.7,
        peak_confidence=0.8, evidence=["e"], lifecycle="Active",
        first_seen=[2023, 318, 22, 13, 24, 5000, 0, 0, 0], last_seen="2023-11-14T22:13:25Z",
    )
    put(tmp_path, "s", [HEADER, row(1), row(1), row(2, at="2026-05-28T21:23:14+02:00", **finding)])
    assert SF.read_sessions(spark, str(tmp_path)).log().count() == 3
    rec = SF.read_sessions(spark, str(tmp_path), dedup=True)
    assert rec.log().count() == 2
    f = rec.findings.first()
    assert (f.first_seen_us, f.last_seen_us) == (1_700_000_004_000_005, 1_700_000_005_000_000)
    assert abs(f.confidence - 0.7) < 1e-6 and f.at_us == 1_779_996_194_000_000
    assert rec.gateway.first().at_us % 1_000_000 == 123_456


def test_repeated_ids_of_different_rows_stay(spark, tmp_path):
    put(tmp_path, "s", [HEADER, row(1), row(2), row(1, at="2026-05-28T20:00:00Z"), row(2, at="2026-05-28T20:00:09Z")])
    assert SF.read_sessions(spark, str(tmp_path), dedup=True).log().count() == 4


def test_written_lines_equal_the_lines_read(spark, tmp_path):
    event = {"type": "GatewayLatency", "target": "10.0.0.1", "rtt": {"secs": 0, "nanos": 7_000_000}, "reachable": True,
             "probe": "icmp"}
    lines = [{**row(100 * i, **event), "source": "probe-b"} for i in (1, 2)]
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "s", [{**HEADER, "label": "home"}, *lines])
    found = SF.scan_sessions(spark, str(tmp_path / "in"))
    name = F.regexp_extract("session_id", "([^/]+)$", 1)
    rows = SF.envelopes_of(SF.to_recording(found.strict())).withColumn("session_id", name)
    SF.write_sessions(rows, str(tmp_path / "out"), headers=found.sessions.withColumn("session_id", name))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert back[1:] == lines
    assert (back[0]["label"], back[0]["tool_version"], back[0]["created_at"]) == ("home", "0.1.0", "2026-05-28T19:23:13.381101Z")


def test_header_that_is_no_object(spark, tmp_path):
    put(tmp_path, "list", ["[1, 2]"])
    put(tmp_path, "number", ["17"])
    put(tmp_path, "version", [{**HEADER, "format_version": 2.0}])
    got = {k: r.status for k, r in by_name(SF.scan_sessions(spark, str(tmp_path)).sessions).items()}
    assert got == {"list": "MissingHeader", "number": "MissingHeader", "version": "BadJson"}


@pytest.mark.parametrize("layout", [Layout(), Layout(2, 1)])
def test_round_trip_of_every_variant(spark, make, tmp_path, layout):
    rec = make(
        layout=layout,
        gateway=[gateway("a", 1, 1, 7.5), gateway("b", 1, 1, 8)],
        dns=[dns("a", 2, 2, 12, False, "timeout")],
        wifi=[wifi("a", 3, 3), wifi("a", 4, 4, rssi=None, ssid=None, bssid=None, channel=None, band=None)],
        counters=[counters("a", 5, 5, 100, 50, errors=(1, 2))],
        health=[health("a", 6, 6, "wifi", "Stale")],
        scans=[("a", 7, 7_000_000, "en0", 2), ("b", 2, 2_000_000, "en0", 0)],
        neighbors=[neighbor("a", 7, 0, 6, "N", "cc", -60), neighbor("a", 7, 1, 11)],
        iface_states=[("a", 8, 8_000_000, "en0", "Down", "Up")],
        roams=[("a", 9, 9_000_000, "Home", "aa", "bb", -70, None)],
        findings=[("a", 10, 10_000_000, "DnsPathology", "fp", "h", 0.5, 0.75, ["x", "y"], "Active", 1_000_000, 2_000_000)],
    )
    path = str(tmp_path / "out")
    SF.write_sessions(SF.envelopes_of(rec), path, layout=layout)
    back = SF.read_sessions(spark, path, by_folder=True)
    for name in rec.streams:
        want = sorted(map(repr, (tuple(r)[2:] for r in rec.stream(name).collect())))
        got = sorted(map(repr, (tuple(r)[2:] for r in back.stream(name).drop(*ORIGIN).collect())))
        assert got == want, name
    assert sorted(map(repr, (tuple(r)[2:] for r in back.neighbors.collect()))) == sorted(
        map(repr, (tuple(r)[2:] for r in rec.neighbors.collect()))
    )
    order = [r.id for r in SF.scan_sessions(spark, path, by_folder=True).good().where("session_id like '%=a'").orderBy("seq").collect()]
    assert order == list(range(1, 11))


def test_land_and_tail(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "s", [HEADER, row(1), row(1), "{bad", row(2), row(3, type="SensorHealth", sensor="wifi", state="Stale")])
    SF.land(SF.scan_sessions(spark, str(src)), str(tmp_path / "batch"))
    landed = SF.read_landed(spark, str(tmp_path / "batch"))
    assert [r.status for r in landed.sessions.collect()] == ["ok"]
    assert landed.good().count() == 4 and [r.error for r in landed.bad().collect()] == ["BadJson"]
    assert [r.id for r in landed.truncated().collect()] == [1, 1]
    rec = SF.to_recording(SF.deduplicate(landed.good()))
    assert (rec.gateway.count(), rec.health.count()) == (2, 1)
    query = TAIL.land_stream(TAIL.tail(spark, str(src)), str(tmp_path / "live"), str(tmp_path / "cp"))
    query.awaitTermination()
    put(src, "s2", [HEADER, row(7), row(8)])
    TAIL.land_stream(TAIL.tail(spark, str(src)), str(tmp_path / "live"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "live"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 7, 8]


def test_ids_and_backlog(make):
    from linklore.operators.projections import backlog

    rec = make(gateway=[gateway("a", 10 * i, i, 5) for i in range(5)])
    assert [r.id for r in SF.assign_ids(rec.log()).orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    assert sorted(r.seq for r in backlog(rec, 2).collect()) == [30, 40]
    assert backlog(rec, 0).count() == 0
    long = make(gateway=[gateway("a", i, i, 5) for i in range(3000)])
    assert sorted(r.seq for r in backlog(long, 1500).collect()) == list(range(1500, 3000))


def test_live_findings_equal_a_replay(spark, tmp_path):
    from linklore.operators.lifecycle import findings
    from linklore.streaming.live import analyze_batches, current_findings

    src = tmp_path / "in"
    src.mkdir()

    def probes(first, n, lost):
        return [
            row(i, at=f"2026-05-28T19:{i // 60:02d}:{i % 60:02d}Z", type="GatewayLatency", target="gw",
                rtt={"secs": 0, "nanos": 7_000_000}, reachable=i % 2 > 0 or not lost, probe="icmp")
            for i in range(first, first + n)
        ]

    def live():
        (
            TAIL.tail(spark, str(src)).writeStream.option("checkpointLocation", str(tmp_path / "cp"))
            .foreachBatch(analyze_batches(str(tmp_path / "events"), str(tmp_path / "found")))
            .trigger(availableNow=True).start().awaitTermination()
        )

    put(src, "a", [HEADER, *probes(1, 20, True)])
    put(src, "quiet", [HEADER, *probes(1, 5, False)])
    live()
    assert [r.lifecycle for r in current_findings(spark, str(tmp_path / "found")).orderBy("at_us").collect()][0] == "Active"
    put(src, "b", [HEADER, *probes(1, 12, True)])
    live()
    got = current_findings(spark, str(tmp_path / "found"))
    want = findings(SF.read_sessions(spark, str(src)))
    cols = ["session_id", "at_us", "fingerprint", "lifecycle", "headline"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {r.session_id[-1] for r in got.collect()} == {"a", "b"}


# -- tail of growing files


def append(folder, name, lines, end="\n"):
    with open(folder / name, "a") as file:
        file.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + end)


def test_appended_lines_arrive_once_across_restarts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def landed():
        TAIL.land_tail(TAIL.tail_rows(spark, str(src)), str(tmp_path / "live"), str(tmp_path / "cp")).awaitTermination()
        events = spark.read.parquet(f"{tmp_path}/live/events").collect()
        wrong = spark.read.parquet(f"{tmp_path}/live/rejected").collect()
        name = lambda r: r.session_id.rsplit("/", 1)[1]
        return sorted((name(r), r.id) for r in events), sorted((name(r), r.error) for r in wrong)

    append(src, "a", [HEADER, row(1), row(2)])
    assert landed() == ([("a", 1), ("a", 2)], [])
    half = json.dumps(row(4))
    append(src, "a", [row(3), "{bad", HEADER, half[:30]], end="")
    append(src, "none", [row(1), row(2)])
    append(src, "other", [HEADER | {"kind": "else"}, row(1)])
    expected = [("a", "BadJson"), ("a", "DuplicateHeader"), *[("none", "MissingHeader")] * 2, *[("other", "WrongKind")] * 2]
    assert landed() == ([("a", 1), ("a", 2), ("a", 3)], expected)
    # The line is completed, ids restart with another time, and a new file comes.
    append(src, "a", [half[30:], row(1, at="2026-05-28T20:00:00Z"), "", row(2, at="2026-05-28T20:00:01Z")])
    append(src, "b", ["", HEADER, row(9)])
    want = [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("a", 3), ("a", 4), ("b", 9)]
    assert landed() == (want, expected)
    assert landed() == (want, expected)  # nothing new


def test_ranges_of_a_file_give_every_line_once(tmp_path):
    from linklore.sources.growing import GrowingReader

    lines = [("x" * (i * 37 % 300)) + str(i) for i in range(400)]
    (tmp_path / "f").write_text("\n".join(lines) + "\n" + "open line")
    for size in (50, 333, 100_000):
        reader = GrowingReader({"path": f"file://{tmp_path}", "partitionBytes": str(size)})
        end = reader.latestOffset()
        got = [v for part in reader.partitions({}, end) for b in reader.read(part) for v in b.column(2).to_pylist()]
        assert got == lines
        starts = [v for part in reader.partitions({}, end) for b in reader.read(part) for v in b.column(1).to_pylist()]
        assert starts == sorted(set(starts))


def test_tail_keeps_rows_that_share_an_id_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    other = row(1, type="GatewayLatency", target="10.0.0.1", rtt={"secs": 0, "nanos": 9}, reachable=True, probe="icmp")
    append(src, "s", [HEADER, row(1), row(1), other, row(1, at="2026-05-28T19:24:00Z")])
    for dedup, n in ((True, 3), (False, 4)):
        query = TAIL.land_stream(TAIL.tail(spark, str(src), dedup=dedup), f"{tmp_path}/{n}", f"{tmp_path}/cp{n}")
        query.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/{n}").count() == n
        assert TAIL.dropped_late(query) == 0


def test_late_rows_are_counted(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    append(src, "s", [HEADER, row(1, at="2026-05-28T19:00:00Z")])

    def land():
        query = TAIL.land_stream(TAIL.tail(spark, str(src), late="1 minute"), f"{tmp_path}/live", f"{tmp_path}/cp")
        query.awaitTermination()
        return TAIL.dropped_late(query)

    assert land() == 0
    append(src, "s", [row(2, at="2026-05-28T19:30:00Z")])
    assert land() == 0
    append(src, "s", [row(3, at="2026-05-28T19:30:30Z")])  # a batch judges by the watermark before it
    assert land() == 0
    append(src, "s", [row(4, at="2026-05-28T19:05:00Z"), row(5, at="2026-05-28T19:31:00Z")])
    assert land() == 1
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/live").collect()) == [1, 2, 3, 5]


def test_whole_sessions_are_checked_in_one_pass(spark, tmp_path, monkeypatch):
    """Sound files need no second look for the first wrong row; a wrong one is still named."""
    header = '{"row":"header","kind":"%s","format_version":2,"created_at":"2024-01-01T00:00:00Z","tool_version":"1","label":null}' % SF.DEFAULT_KIND
    event = (
        '{"row":"envelope","id":1,"at":"2024-01-01T00:00:01Z","source":"iface",'
        '"event":{"type":"SensorHealth","sensor":"iface","state":"Stale","backend":"b","detail":null}}'
    )
    (tmp_path / "a.jsonl").write_text("\n".join([header, event, event]))
    looked = []
    second = SF.SessionScan.bad
    monkeypatch.setattr(SF.SessionScan, "bad", lambda self: looked.append(1) or second(self))
    assert SF.scan_sessions(spark, str(tmp_path)).strict().count() == 2 and not looked
    (tmp_path / "b.jsonl").write_text("\n".join([header, event, "{"]))
    with pytest.raises(SF.SessionError, match="BadJson in .*b.jsonl, line 3"):
        SF.scan_sessions(spark, str(tmp_path)).strict()
    assert looked
