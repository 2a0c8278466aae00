"""Landmarks and projections against step-by-step models on random sessions."""

import random

import pytest
from pyspark.sql import functions as F

from linklore.operators import landmarks as M
from linklore.operators import projections as P
from linklore.plans.sequence import WHOLE, Layout

from .conftest import counters, dns, gateway, health, neighbor, wifi

S = 1_000_000


def gateway_model(rows):
    """(commit seq, anchor seq, stance) of held stances, from the definition."""
    ms, marks, shown, run = [], [], None, []
    for _, seq, _, _, _, rtt, ok, _ in rows:
        ms = (ms + [rtt])[-30:]
        limit = sorted(ms)[len(ms) // 2] * 1.5 + 5
        stance = "stable" if ok and rtt <= limit else "spiking" if ok else "unreachable"
        run = run + [(seq, stance)] if run and run[-1][1] == stance else [(seq, stance)]
        if len(run) >= 3 and shown != stance:
            if shown is not None or stance != "stable":
                marks.append((seq, run[0][0]))
            shown = stance
    return marks


def throughput_model(rows):
    high, quiet = ("sustained", "bursting"), ("idle", "trickle")
    marks, shown, prev, start = [], None, None, None
    for r in rows:
        seq, at, rx, tx = r[1], r[2], r[4], r[5]
        if prev and at > prev[0] and rx >= prev[1] and tx >= prev[2]:
            peak = max(rx - prev[1], tx - prev[2]) / ((at - prev[0]) / S) * 8
            now = "idle" if peak < 5e4 else "trickle" if peak < 5e5 else "sustained" if peak < 25e6 else "bursting"
            if start is None or start[0] != now:
                start = (now, at, seq)
            if (at - start[1]) // S >= 10 and shown != now:
                worth = (
                    now in high if shown is None
                    else now == "bursting" or (now == "sustained" and shown in quiet) or (now == "idle" and shown in high)
                )
                if worth:
                    marks.append((seq, start[2]))
                shown = now
        prev = (at, rx, tx)
    return marks


@pytest.mark.parametrize("layout", [WHOLE, Layout(9, 13 * S)])
def test_held_stances_on_random_sessions(make, layout):
    rng = random.Random(3)
    gw, ct = {}, {}
    for s in map(str, range(60)):
        at = seq = 0
        gw[s], ct[s] = [], []
        for _ in range(rng.randint(3, 12)):
            level, ok = rng.choice([(5, True), (60, True), (5, False)])
            for _ in range(rng.randint(1, 6)):
                at, seq = at + 1, seq + 1
                gw[s].append(gateway(s, seq, at, level + rng.random(), ok))
        at, rx = 0, 0
        for _ in range(rng.randint(3, 12)):
            rate = rng.choice([0, 30_000, 300_000, 5_000_000])
            for _ in range(rng.randint(1, 9)):
                step = rng.randint(0, 5)
                at, seq = at + step, seq + 1
                rx = 0 if rng.random() < 0.06 else rx + rate * step
                ct[s].append(counters(s, seq, at, rx))
    rec = make(layout=layout, gateway=sum(gw.values(), []), counters=sum(ct.values(), []))
    for marks, rows, model in (
        (M.from_gateway(rec).collect(), gw, gateway_model),
        (M.from_throughput(rec).collect(), ct, throughput_model),
    ):
        for s in rows:
            got = sorted((r.commit_seq, r.seq) for r in marks if r.session_id == s)
            assert got == model(rows[s]), (s, model.__name__)


def test_spike_after_idle_reads_as_wakeup(make):
    spikes = [gateway(s, 10 + i, 20 + i, 5 if i < 5 else 90) for s in ("idle", "busy") for i in range(8)]
    traffic = [counters("busy", i, 2 * i, 3_000_000 * i) for i in range(9)]
    marks = {r.session_id: r for r in M.from_gateway(make(gateway=spikes, counters=traffic)).collect()}
    assert marks["idle"].severity == "Notable" and marks["idle"].headline.endswith("wakeup likely")
    assert marks["busy"].severity == "Alarm" and marks["busy"].headline == "Gateway spiking · gw 90.0 ms"


def test_health_and_dns_flips(make):
    rec = make(
        dns=[dns("a", i, i, 5, ok) for i, ok in enumerate([True, False, False, True])],
        health=[
            health("a", 10 + i, i, *x)
            for i, x in enumerate([("wifi", "Operational"), ("wifi", "Operational"), ("wifi", "Stale"), ("dns", "Stale"), ("wifi", "Operational")])
        ],
    )
    assert [r.severity for r in M.from_dns(rec).orderBy("seq").collect()] == ["Alarm", "Recovery"]
    assert [r.headline for r in M.from_health(rec).orderBy("seq").collect()] == [
        "wifi → Stale", "dns → Stale", "wifi recovered (was Stale)",
    ]


def marks_of(spark, rows):
    return spark.createDataFrame(
        [(s, c, q, at * S, "Dns", sev, "h") for s, c, q, at, sev in rows],
        "session_id string, commit_seq bigint, seq bigint, at_us bigint, category string, severity string, headline string",
    )


def test_strip_columns_and_severity(spark, make):
    rec = make(gateway=[gateway("a", 0, 0, 5), gateway("a", 99, 60, 5), gateway("zero", 0, 0, 5)])
    rows = [("a", 1, 1, 12, "Notable"), ("a", 2, 2, 60, "Recovery"), ("a", 3, 3, 1, "Notable"), ("a", 4, 4, 2, "Alarm"),
            ("a", 5, 5, 3, "Recovery"), ("zero", 1, 1, 0, "Alarm")]
    cells = P.timeline_strip(rec, marks_of(spark, rows), 10).collect()
    a = {r.col: (r.n, r.worst_severity, r.density) for r in cells if r.session_id == "a"}
    assert a[2] == (1, "Notable", "one") and a[9] == (1, "Recovery", "one") and a[0] == (3, "Alarm", "few")
    assert len(a) == 10 and sum(r.n for r in cells) == 5


def test_playhead_navigation(spark, make):
    rec = make(gateway=[gateway("a", i, i, 5) for i in range(10)])
    marks = marks_of(spark, [("a", 3, 3, 3, "Alarm"), ("a", 7, 7, 7, "Alarm")])
    heads = spark.createDataFrame([("a", x) for x in (9, 7, 3, 0)], "session_id string, playhead_seq bigint")
    got = {
        r.playhead_seq: (r.current_index, r.prev_seq, r.next_seq)
        for r in M.around_playhead(marks, heads, rec).collect()
    }
    assert got == {9: (1, 7, None), 7: (1, 3, None), 3: (0, None, 7), 0: (-1, None, 3)}


def waterfall_model(scans, max_rows, max_cols):
    window = scans[-max_cols:]
    universe = {k for counts, on in window for k in [*counts, *([on] if on else [])]}
    keep = set(universe)
    if len(universe) > max_rows:
        keep = set()
        for _, on in reversed(window):
            if on and len(keep) < max_rows - 1:
                keep.add(on)
        total = lambda k: sum(c.get(k, 0) for c, _ in window)
        for k in sorted(universe - keep, key=lambda k: (-total(k), k)):
            if len(keep) < max_rows - 1:
                keep.add(k)
    cells = {}
    for col, (counts, on) in enumerate(window):
        for k in keep:
            cells[(k, col)] = (counts.get(k, 0), on == k)
        if universe - keep:
            rest = universe - keep
            cells[(None, col)] = (sum(v for k, v in counts.items() if k in rest), on in rest)
    return cells, len(universe - keep)


def test_waterfall_on_random_sessions(make):
    rng = random.Random(5)
    channels = [(0, 1), (0, 6), (1, 36), (1, 44), (1, 149)]
    bands = {0: "TwoPointFourGhz", 1: "FiveGhz"}
    links, scans, heard, model = [], [], [], {}
    for s in map(str, range(25)):
        on, seq, history = None, 0, []
        for _ in range(rng.randint(1, 9)):
            if rng.random() < 0.5:
                seq += 1
                on = rng.choice(channels)
                links.append(wifi(s, seq, seq, channel=on[1], band=bands[on[0]]))
            seq += 1
            counts = {}
            for pos in range(rng.randint(0, 6)):
                k = rng.choice(channels)
                counts[k] = counts.get(k, 0) + 1
                heard.append(neighbor(s, seq, pos, k[1], band=rng.choice([bands[k[0]], "Unknown"])))
            scans.append((s, seq, seq * S, "en0", sum(counts.values())))
            history.append((counts, on))
        model[s] = history
    rec = make(wifi=links, scans=scans, neighbors=heard)
    for rows, cols in ((3, 4), (9, 20), (1, 5)):
        got = P.waterfall(rec, rows, cols).collect()
        for s, history in model.items():
            cells, hidden = waterfall_model(history, rows, cols)
            mine = {
                (None if r.is_other else (r.band_rank, r.number), r.col): (r.ap_count, r.connected)
                for r in got if r.session_id == s
            }
            assert mine == cells, (s, rows, cols)
            assert all(r.hidden_channels == hidden for r in got if r.session_id == s)


def test_occupancy_order(make):
    heard, pos = [], 0
    for channel, n, band in ((149, 1, "FiveGhz"), (157, 4, "FiveGhz"), (36, 9, "FiveGhz"), (100, 3, "FiveGhz"), (6, 5, "TwoPointFourGhz"), (11, 2, "TwoPointFourGhz")):
        for _ in range(n):
            heard.append(neighbor("a", 2, pos, channel, band=band))
            pos += 1
    rec = make(wifi=[wifi("a", 1, 1, channel=149, band="FiveGhz")], scans=[("a", 2, 2 * S, "en0", pos)], neighbors=heard)
    got = [r.channel_number for r in P.occupancy_ranking(rec).orderBy("place").collect()]
    assert got == [149, 157, 100, 36, 6, 11]
    loose = make(scans=[("a", 2, 2 * S, "en0", pos)], neighbors=heard)
    assert P.occupancy_ranking(loose).orderBy("place").first().channel_number == 36


def test_persistence_needs_three_seconds(make):
    rows = [gateway("long", i, i, 5) for i in range(10)] + [gateway("short", i, i, 5, i < 8) for i in range(10)]
    got = {r.session_id: r.stance for r in P.latency_card(make(gateway=rows)).collect()}
    assert got == {"long": "stable 9s", "short": None}


def test_state_as_of_equals_state_of_a_shorter_recording(make):
    def rec(n):
        return make(
            gateway=[gateway("a", 3 * i, i, 5 + i) for i in range(n)],
            dns=[dns("a", 3 * i + 1, i, 20, i % 3 > 0) for i in range(n)],
            wifi=[wifi("a", 3 * i + 2, i, -50 - i) for i in range(n)],
            health=[health("a", 1000 + i, 500 + i, "wifi", "Stale") for i in range(n - 10)],
            scans=[], counters=[], neighbors=[],
        )

    head = rec(20).spark.createDataFrame([("a", 29, 9 * S)], "session_id string, playhead_seq bigint, playhead_us bigint")
    full = P.state_as_of(rec(20), head).collect()
    assert full == P.state_as_of(rec(10), head).collect() and full[0].events == 30
