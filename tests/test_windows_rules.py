"""Hand-made windows: what fires, what stays silent, what resets."""

from linklore.operators import rules as R
from linklore.operators import summary as SM
from linklore.operators import timeline as T
from linklore.operators import windows as W
from linklore.params import Params

from .conftest import counters, dns, gateway, health, neighbor, wifi


def last(df, session):
    return max((r for r in df.collect() if r.session_id == session), key=lambda r: r.seq)


def test_upper_median_p95_and_loss(make):
    rows = [gateway("a", i, i, ms) for i, ms in enumerate([1, 2, 3, 4])]
    rows += [gateway("b", 0, 0, 5), gateway("b", 1, 30, 7, ok=False), gateway("b", 2, 31, 9)]
    df = W.gateway_window(make(gateway=rows))
    a, b = last(df, "a"), last(df, "b")
    assert (a.n, a.median_ms, a.p95_ms, a.loss) == (4, 3.0, 4.0, 0.0)
    assert (b.n, b.median_ms, b.loss) == (2, 9.0, 0.5)


def test_rows_of_equal_time_count_only_when_earlier(make):
    rows = [gateway("a", i, 0, 10 + i) for i in range(5)]
    df = W.gateway_window(make(gateway=rows)).orderBy("seq").collect()
    assert [r.n for r in df] == [1, 2, 3, 4, 5]


def test_signal_delta_and_reset_on_new_access_point(make):
    times = [-60, -45, -37, -25, -12, -5]
    rows = [wifi("a", i, 100 + t, r) for i, (t, r) in enumerate(zip(times, [-50, -49, -50, -55, -56, -57]))]
    rows += [wifi("b", i, 100 + t, -50, bssid="x" if t < -20 else "y") for i, t in enumerate(times)]
    df = W.signal_window(make(wifi=rows))
    assert last(df, "a").card_delta < -5
    b = last(df, "b")
    assert b.card_delta is None and b.associated_secs == 7 and b.samples == 2


def test_lost_radio_starts_a_new_association(make):
    rec = make(
        wifi=[wifi("a", 0, 0), wifi("a", 1, 10), wifi("a", 3, 30)],
        health=[health("a", 2, 20, "wifi", "HardwareDisabled")],
    )
    rows = W.signal_window(rec).orderBy("seq").collect()
    assert [r.associated_secs for r in rows] == [0, 10, 0]


def test_throughput_rates_resets_and_last_two_samples(make):
    rows = [counters("a", 0, 0, 0), counters("a", 1, 10, 1_000_000)]
    rows += [counters("step", i, 2 * i, r) for i, r in enumerate([0, 0, 1_000_000])]
    rows += [counters("fell", 0, 0, 500), counters("fell", 1, 5, 100)]
    rows += [counters("swap", 0, 0, 500), counters("swap", 1, 5, 900, interface="en7")]
    rows += [counters("old", 0, 0, 0), counters("old", 1, 100, 1_000_000)]
    rows += [counters("evict", i, 5 * i, 5_000_000 * i) for i in range(5)]
    df = W.throughput_window(make(counters=rows))
    assert last(df, "a").rx_bps == 800_000
    assert last(df, "step").step_rx_bps == 4_000_000
    assert last(df, "fell").rx_bps is None and last(df, "swap").rx_bps is None
    assert last(df, "old").rx_bps == 80_000
    assert last(df, "evict").rx_bps == 8_000_000 and last(df, "evict").span_secs == 15


def fired(rec, rule):
    df = R.evaluate(T.timeline(rec, R.RULES[rule].needs), rec.params, {rule: R.RULES[rule]})
    return {r.session_id: r for r in df.where("is_tick = 0").orderBy("at_us", "seq").collect()}


def test_gateway_rule(make):
    def probes(s, values, lost=()):
        return [gateway(s, 10 + i, i, v, i not in lost) for i, v in enumerate(values)]

    rows = probes("idle spike", [5] * 9 + [80]) + probes("active spike", [5] * 9 + [80])
    rows += probes("sustained", [5] * 8 + [80, 90]) + probes("lossy", [5] * 10, {1, 3, 5, 7})
    rows += probes("few", [5, 80, 90, 80]) + probes("dead", [900] * 10, set(range(10)))
    busy = [counters("active spike", 0, 0, 0), counters("active spike", 1, 8, 10_000_000)]
    hit = fired(make(gateway=rows, counters=busy), "gateway_instability")
    assert set(hit) == {"active spike", "sustained", "lossy"}
    assert hit["lossy"].confidence > 0.3
    assert hit["lossy"].fingerprint == "gateway_instability:gw"
    assert "active" in hit["active spike"].evidence[-1] and "idle" in hit["sustained"].evidence[-1]


def scan_row(s, seq, secs, n):
    return (s, seq, int(secs * 1_000_000), "en0", n)


def test_congestion_rule(make):
    links = [wifi(s, 0, 0, channel=c) for s, c in (("seven", 11), ("five", 11), ("elsewhere", 36))]
    scans, heard = [], []
    for s, n, ch in (("seven", 7, 11), ("five", 5, 11), ("elsewhere", 9, 6), ("unassociated", 9, 11)):
        scans.append(scan_row(s, 1, 1, n))
        heard += [neighbor(s, 1, i, ch) for i in range(n)]
    hit = fired(make(wifi=links, scans=scans, neighbors=heard), "rf_congestion")
    assert set(hit) == {"seven"}
    assert hit["seven"].fingerprint.endswith(":ch11") and "elevated" in hit["seven"].headline


def test_sticky_client_prefers_the_first_of_equals(make):
    rec = make(
        wifi=[wifi("a", 0, 0, -75)],
        scans=[scan_row("a", 1, 1, 4)],
        neighbors=[
            neighbor("a", 1, 0, 1, "Home", "aa", -40), neighbor("a", 1, 1, 1, "Home", "cc", -60),
            neighbor("a", 1, 2, 1, "Home", "bb", -60), neighbor("a", 1, 3, 1, "Other", "dd", -30),
        ],
    )
    hit = fired(rec, "sticky_client")["a"]
    assert "cc is -60 dBm" in hit.headline and round(hit.confidence, 3) == 0.6


def test_resolver_rule_trusts_a_healthy_gateway_more(make):
    rows = [dns(s, 10 + i, i, 20, i % 2 == 0) for s in ("good", "none") for i in range(4)]
    rec = make(dns=rows, gateway=[gateway("good", i, 0.1 * i, 5) for i in range(3)])
    hit = fired(rec, "dns_pathology")
    assert hit["good"].confidence > hit["none"].confidence
    assert "healthy: false" in hit["none"].evidence[2]


def test_roams_need_two_known_access_points_of_one_network(make):
    rows = [
        wifi("a", 0, 0, bssid="x"), wifi("a", 1, 1, bssid="y"), wifi("a", 2, 2, bssid=None),
        wifi("a", 3, 3, bssid="z"), wifi("a", 4, 4, bssid="w", ssid="Other"),
    ]
    assert [(r.from_bssid, r.to_bssid) for r in SM.roams(make(wifi=rows)).collect()] == [("x", "y")]


def test_coverage(make):
    p = Params(expected_sources=("gateway", "dns"))
    rec = make(
        params=p,
        gateway=[gateway(s, i, 40 * i, 5) for s in ("full", "point", "off", "back") for i in range(2)],
        dns=[dns("full", 2, 0, 5), dns("full", 3, 30, 5), dns("point", 2, 0, 5)],
        health=[
            health("off", 2, 1, "dns", "Stale"), health("back", 2, 1, "dns", "Stale"),
            health("back", 3, 2, "dns", "Operational"), health("full", 9, 2, "unknown", "Stale"),
        ],
    )
    got = {r.session_id: r.satisfied for r in SM.coverage_overall(rec).collect()}
    assert got == {"full": True, "point": False, "off": True, "back": False}


def test_elevated_at_exactly_twice_the_median(spark, make):
    """Collected and selected frames count by one rule."""
    from linklore.plans.sequence import Layout

    rows, seq = [], 0
    for i, nanos in enumerate([837_108_039, 7_000_000, 333_333_333, 123_456_789, 999_999_937, 1, 600_000_001]):
        for times, extra in ((1, 0), (1, 0), (1, 0), (2, 0), (2, 1), (2, -1)):
            seq += 1
            value = max(0, nanos * times + extra)
            rows.append((f"s{i}", seq, seq * 1000, "gw", value, (value // 10**9 + value % 10**9 / 1e9) * 1000.0, True, "icmp"))
    whole = W.gateway_window(make(gateway=rows))
    cut = W.gateway_window(make(layout=Layout(3, 3000, frame_rows=2), gateway=rows))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_probes_without_a_time_are_their_own_frame(make):
    """They come before all others: each counts those of its kind up to itself."""
    rows = [gateway("s", i, 0, 5.0) for i in range(3)]
    rows = [(*r[:2], None, *r[3:]) for r in rows] + [gateway("s", 3, 10, 5.0), gateway("s", 4, 11, 5.0)]
    got = W.gateway_window(make(gateway=rows)).orderBy("seq").collect()
    assert [r["n"] for r in got] == [1, 2, 3, 1, 2]
