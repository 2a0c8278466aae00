"""The same results as plain SQL for DuckDB, written independently: ASOF joins,
self joins and recursive queries instead of carried window state.

``FRAGMENTS`` are common table expressions; ``build`` puts the ones a query
needs in front of it.
"""

from __future__ import annotations

import re

# Fixed values of the lens: one second is one hour, in microseconds.
U = 3_600_000_000
SEC = "CAST(3600000000 AS DOUBLE)"


def _within(span: int) -> str:
    return f"RANGE BETWEEN {span * U} PRECEDING AND CURRENT ROW"


def _secs(delta: str) -> str:
    """Whole seconds, truncated."""
    return f"CAST(trunc(({delta}) / {SEC}) AS BIGINT)"


def _f32(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def _med(l: str) -> str:
    return f"list_sort({l})[len({l}) // 2 + 1]"


def _p95(l: str) -> str:
    return f"list_sort({l})[least(CAST(floor(len({l}) * CAST(0.95 AS DOUBLE)) AS BIGINT), len({l}) - 1) + 1]"


def _dur(s: str, long: bool = False) -> str:
    hm = f"format('{{}}h{{:02}}m', {s} // 3600, ({s} % 3600) // 60)"
    if long:
        hm = f"format('{{}}h{{:02}}m{{:02}}s', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"
    return (
        f"CASE WHEN {s} >= 3600 THEN {hm} WHEN {s} >= 60 THEN format('{{}}m{{:02}}s', {s} // 60, {s} % 60) "
        f"ELSE format('{{}}s', {s}) END"
    )


def _rate(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 1e9 THEN format('{{:.2f}} Gbps', {x} / 1e9) WHEN {x} >= 1e6 THEN "
        f"format('{{:.1f}} Mbps', {x} / 1e6) WHEN {x} >= 1e3 THEN format('{{:.0f}} Kbps', {x} / 1e3) "
        f"WHEN {x} > 0 THEN format('{{:.0f}} bps', {x}) ELSE 'idle' END"
    )


def _peak(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 'no data' WHEN {x} >= 1e6 THEN format('{{:.1f}} Mbps', {x} / 1e6) "
        f"WHEN {x} >= 1e3 THEN format('{{:.0f}} Kbps', {x} / 1e3) ELSE 'idle' END"
    )


def _bytes(n: str) -> str:
    x = f"CAST({n} AS DOUBLE)"
    return (
        f"CASE WHEN {x} >= 1099511627776 THEN format('{{:.1f}}T', {x} / 1099511627776e0) "
        f"WHEN {x} >= 1073741824 THEN format('{{:.1f}}G', {x} / 1073741824e0) "
        f"WHEN {x} >= 1048576 THEN format('{{:.1f}}M', {x} / 1048576e0) "
        f"WHEN {x} >= 1024 THEN format('{{:.1f}}K', {x} / 1024e0) ELSE format('{{}}B', {n}) END"
    )


def _ms(nanos: str) -> str:
    return f"(CAST({nanos} // 1000000000 AS DOUBLE) + CAST({nanos} % 1000000000 AS DOUBLE) / 1e9) * 1e3"


def _band(n: str) -> str:
    return f"CASE WHEN {n} BETWEEN 1 AND 14 THEN 'TwoPointFourGhz' WHEN {n} BETWEEN 32 AND 177 THEN 'FiveGhz' ELSE 'Unknown' END"


def _band_rank(band: str, n: str) -> str:
    settled = f"(CASE WHEN {band} = 'Unknown' THEN {_band(n)} ELSE {band} END)"
    return f"CASE {settled} WHEN 'TwoPointFourGhz' THEN 0 WHEN 'FiveGhz' THEN 1 WHEN 'SixGhz' THEN 2 ELSE 3 END"


def _tier(n: str) -> str:
    return f"CASE WHEN {n} <= 2 THEN 'low' WHEN {n} <= 5 THEN 'moderate' WHEN {n} <= 8 THEN 'elevated' ELSE 'severe' END"


def _regime(rx: str, tx: str) -> str:
    p = f"greatest({rx}, {tx})"
    return f"CASE WHEN {p} < 50000 THEN 'idle' WHEN {p} < 500000 THEN 'trickle' WHEN {p} < 25000000 THEN 'sustained' ELSE 'bursting' END"


def _good(ms: str, good: str, bad: str) -> str:
    return _f32(
        f"CASE WHEN {ms} <= {good}e0 THEN 1e0 WHEN {ms} >= {bad}e0 THEN 0e0 ELSE 1e0 - ({ms} - {good}e0) / ({bad}e0 - {good}e0) END"
    )


def _rssi_good(r: str) -> str:
    return _f32(f"(greatest(-90, least(-30, {r})) + 90) / 60e0")


def _quality(x: str) -> str:
    return f"CASE WHEN {x} >= {_f32('0.66')} THEN 'ok' WHEN {x} >= {_f32('0.33')} THEN 'warn' ELSE 'bad' END"


def _clamp(x: str, a: str, b: str) -> str:
    return f"greatest(CAST({a} AS DOUBLE), least(CAST({b} AS DOUBLE), {x}))"


CHANNELS = "[1, 6, 11, 36, 149]"
STATE = "['Operational', 'Stale', 'HardwareDisabled'][(k // 6) % 3 + 1]"
VARIANT = (
    "CASE kind WHEN 'view' THEN 'GatewayLatency' WHEN 'error' THEN 'DnsLatency' WHEN 'click' THEN 'Wifi' "
    "WHEN 'purchase' THEN 'InterfaceCounters' ELSE CASE WHEN k % 3 = 0 THEN 'SensorHealth' ELSE 'Scan' END END"
)
SENSOR = "CASE WHEN k % 6 = 0 THEN 'wifi' ELSE 'iface' END"
BPS = "(({a} - {b}) / ({t}) * 8e0)"

FRAGMENTS: dict[str, str] = {
    "ev": """SELECT user_id // 15 AS session_id, event_id AS seq, epoch_us(ts) AS at_us,
        event_type AS kind, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
        CAST(day(ts) AS INTEGER) AS day FROM events""",
    "log": f"""SELECT session_id, seq, at_us, {VARIANT} AS event_type,
        CASE WHEN kind = 'view' THEN 'gateway' WHEN kind = 'error' THEN 'dns' WHEN kind = 'purchase' THEN 'iface'
             WHEN kind = 'signup' AND k % 3 = 0 THEN {SENSOR} ELSE 'wifi' END AS source,
        CASE WHEN kind = 'signup' AND k % 3 = 0 THEN {STATE} END AS health_state FROM ev""",
    "gateway": f"""SELECT session_id, seq, at_us, 'gw0' AS target, {_ms('CAST(round(value * 1000000) AS BIGINT)')} AS rtt_ms,
        k % 8 <> 0 AS reachable, 'icmp' AS probe FROM ev WHERE kind = 'view'""",
    "dns": f"""SELECT session_id, seq, at_us, 'system' AS resolver, 'q' || (k % 3) AS query,
        {_ms('CAST(round(value * 4000000) AS BIGINT)')} AS rtt_ms, k % 4 <> 0 AS answered,
        CASE WHEN k % 4 = 0 THEN 'timeout' END AS error FROM ev WHERE kind = 'error'""",
    "wifi": f"""SELECT session_id, seq, at_us, 's' || (day // 16) AS ssid,
        CASE WHEN k = 1 THEN 'b9' WHEN k <> 0 THEN 'b' || ((day // 6) % 4) END AS bssid,
        -30 - CAST(trunc(value) AS INTEGER) % 60 AS rssi_dbm, -95 AS noise_dbm,
        {CHANNELS}[k % 5 + 1] AS channel_number,
        CASE WHEN k % 10 = 2 THEN 'Unknown' ELSE {_band(CHANNELS + '[k % 5 + 1]')} END AS channel_band
        FROM ev WHERE kind = 'click'""",
    "counters0": """SELECT session_id, seq, at_us, k,
        CAST(trunc(value) AS BIGINT) * [500, 5000, 50000, 1000000][day % 4 + 1] AS rx,
        count(*) FILTER (k % 20 = 0) OVER (PARTITION BY session_id ORDER BY seq) AS e
        FROM ev WHERE kind = 'purchase'""",
    "counters": """SELECT session_id, seq, at_us, 'en0' AS interface, CAST(sum(rx) OVER w AS BIGINT) AS rx_bytes,
        CAST(sum(k * 100) OVER w AS BIGINT) AS tx_bytes, CAST(sum(k % 3) OVER w AS BIGINT) AS rx_errors,
        CAST(sum(k % 2) OVER w AS BIGINT) AS tx_errors FROM counters0
        WINDOW w AS (PARTITION BY session_id, e ORDER BY seq)""",
    "health": f"""SELECT session_id, seq, at_us, {SENSOR} AS sensor, {STATE} AS state FROM ev
        WHERE kind = 'signup' AND k % 3 = 0""",
    "scan_rows": "SELECT session_id, seq, at_us FROM ev WHERE kind = 'signup' AND k % 3 <> 0",
    "neighbors": f"""SELECT s.session_id, s.seq AS scan_seq, l_orderkey * 8 + l_linenumber AS pos,
        'b' || l_linenumber AS bssid, 's' || (l_suppkey % 2) AS ssid,
        -40 - CAST(trunc(l_quantity) AS INTEGER) AS rssi_dbm, {CHANNELS}[l_suppkey % 5 + 1] AS channel_number,
        CASE WHEN l_linenumber % 4 = 0 THEN 'Unknown' ELSE {_band(CHANNELS + '[l_suppkey % 5 + 1]')} END AS channel_band
        FROM scan_rows s JOIN lineitem ON l_partkey = s.seq // 5""",
    "scans": """SELECT s.session_id, s.seq, s.at_us, count(n.pos) AS n_neighbors FROM scan_rows s
        LEFT JOIN neighbors n ON n.session_id = s.session_id AND n.scan_seq = s.seq GROUP BY ALL""",
    "wifi_lost": "SELECT * FROM health WHERE sensor = 'wifi' AND state IN ('HardwareDisabled', 'BackendUnavailable', 'PermissionDenied')",
    "iface_lost": "SELECT * FROM health WHERE sensor = 'iface' AND state IN ('Stale', 'BackendUnavailable', 'HardwareDisabled')",
    # windows
    "gww0": f"""SELECT session_id, seq, at_us, target, count(*) OVER w AS n, count(*) FILTER (NOT reachable) OVER w AS lost,
        list(rtt_ms) FILTER (reachable) OVER w AS l FROM gateway
        WINDOW w AS (PARTITION BY session_id ORDER BY at_us {_within(30)})""",
    "gww": f"""SELECT session_id, seq, at_us, target, n, {_f32('CAST(lost AS DOUBLE) / n')} AS loss, {_med('l')} AS median_ms,
        {_p95('l')} AS p95_ms, coalesce(len(list_filter(l, lambda x: x > 2e0 * {_med('l')})), 0) AS elevated FROM gww0""",
    "dnsw0": f"""SELECT session_id, seq, at_us, count(*) OVER w AS n, count(*) FILTER (NOT answered) OVER w AS lost,
        list(rtt_ms) FILTER (answered) OVER w AS l FROM dns
        WINDOW w AS (PARTITION BY session_id ORDER BY at_us {_within(30)})""",
    "dnsw": f"SELECT session_id, seq, at_us, n, {_f32('CAST(lost AS DOUBLE) / n')} AS fail, {_med('l')} AS median_ms FROM dnsw0",
    "assoc0": """SELECT session_id, seq, at_us, false AS lost, ssid, bssid, rssi_dbm FROM wifi UNION ALL
        SELECT session_id, seq, at_us, true, NULL, NULL, NULL FROM wifi_lost""",
    "assoc1": """SELECT *, NOT coalesce(NOT lost AND NOT lag(lost) OVER w AND ssid IS NOT DISTINCT FROM lag(ssid) OVER w
        AND bssid IS NOT DISTINCT FROM lag(bssid) OVER w, false) AS starts FROM assoc0
        WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
    "assoc2": "SELECT *, count(*) FILTER (starts) OVER (PARTITION BY session_id ORDER BY seq) AS epoch FROM assoc1",
    "assoc": """SELECT *, min(at_us) OVER (PARTITION BY session_id, epoch) AS since_us,
        coalesce(bssid, ssid, 'current') AS identity_key FROM assoc2""",
    "sigw": f"""SELECT session_id, seq, at_us, ssid, bssid, rssi_dbm, epoch, identity_key, since_us,
        greatest(0, {_secs('at_us - since_us')}) AS associated_secs,
        count(rssi_dbm) OVER (PARTITION BY session_id, epoch ORDER BY at_us {_within(300)}) AS samples
        FROM assoc WHERE NOT lost""",
    "cnt0": """SELECT session_id, seq, at_us, false AS lost, interface, rx_bytes, tx_bytes, rx_errors, tx_errors FROM counters
        UNION ALL SELECT session_id, seq, at_us, true, NULL, NULL, NULL, NULL, NULL FROM iface_lost""",
    "cnt1": """SELECT *, NOT coalesce(NOT lost AND NOT lag(lost) OVER w AND interface = lag(interface) OVER w
        AND rx_bytes >= lag(rx_bytes) OVER w AND tx_bytes >= lag(tx_bytes) OVER w, false) AS starts FROM cnt0
        WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
    "cnt": "SELECT *, count(*) FILTER (starts) OVER (PARTITION BY session_id ORDER BY seq) AS epoch FROM cnt1",
    "tp0": f"""SELECT *, lag(seq) OVER (PARTITION BY session_id, epoch ORDER BY seq) AS prev_seq,
        min(seq) OVER (PARTITION BY session_id, epoch ORDER BY at_us {_within(15)}) AS oldest FROM cnt WHERE NOT lost""",
    "tp1": """SELECT t.*, f.at_us AS f_at, f.rx_bytes AS f_rx, f.tx_bytes AS f_tx, f.rx_errors AS f_rxe, f.tx_errors AS f_txe,
        p.at_us AS p_at, p.rx_bytes AS p_rx, p.tx_bytes AS p_tx FROM tp0 t
        LEFT JOIN counters f ON f.seq = CASE WHEN t.oldest < t.seq THEN t.oldest ELSE t.prev_seq END
        LEFT JOIN counters p ON p.seq = t.prev_seq""",
    "tput": f"""SELECT session_id, seq, at_us, interface, epoch,
        CASE WHEN (at_us - f_at) / {SEC} >= 1 THEN (rx_bytes - f_rx) / ((at_us - f_at) / {SEC}) * 8e0 END AS rx_bps,
        CASE WHEN (at_us - f_at) / {SEC} >= 1 THEN (tx_bytes - f_tx) / ((at_us - f_at) / {SEC}) * 8e0 END AS tx_bps,
        CASE WHEN (at_us - f_at) / {SEC} >= 1 THEN {_secs('at_us - f_at')} END AS span_secs,
        CASE WHEN at_us > p_at THEN (rx_bytes - p_rx) / ((at_us - p_at) / {SEC}) * 8e0 END AS step_rx_bps,
        CASE WHEN at_us > p_at THEN (tx_bytes - p_tx) / ((at_us - p_at) / {SEC}) * 8e0 END AS step_tx_bps,
        coalesce(greatest(0, rx_errors - f_rxe), 0) + coalesce(greatest(0, tx_errors - f_txe), 0) AS errors FROM tp1""",
    "rmed": f"""SELECT session_id, seq, at_us, target, reachable, rtt_ms, {_med('l')} AS median_ms FROM (
        SELECT *, list(rtt_ms) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM gateway)""",
    "step0": """SELECT session_id, seq, at_us, rx_bytes, tx_bytes, lag(at_us) OVER w AS p_at, lag(rx_bytes) OVER w AS p_rx,
        lag(tx_bytes) OVER w AS p_tx FROM counters WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
    "step1": f"""SELECT session_id, seq, at_us, (rx_bytes - p_rx) / ((at_us - p_at) / {SEC}) * 8e0 AS rx_bps,
        (tx_bytes - p_tx) / ((at_us - p_at) / {SEC}) * 8e0 AS tx_bps FROM step0
        WHERE at_us > p_at AND rx_bytes >= p_rx AND tx_bytes >= p_tx""",
    "step": f"SELECT *, {_regime('rx_bps', 'tx_bps')} AS regime FROM step1",
    # timeline
    "ends": "SELECT session_id, min(at_us) AS first_us, max(at_us) AS last_us, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY 1",
    "tick": f"""SELECT session_id, i AS seq, first_us + i * {2 * U} AS at_us FROM (SELECT session_id, first_us,
        unnest(range(0, (last_us - first_us + {20 * U}) // {2 * U} + 2)) AS i FROM ends)""",
    "inst": """SELECT session_id, at_us, 0 AS is_tick, seq FROM log
        WHERE event_type IN ('GatewayLatency', 'DnsLatency', 'Scan', 'Wifi')
        UNION ALL SELECT session_id, at_us, 1, seq FROM tick""",
    "chan": """SELECT session_id, scan_seq, channel_number, count(*) AS ap_count FROM neighbors GROUP BY ALL""",
    "asof1": """SELECT i.*, w.seq AS wifi_seq, w.ssid, w.bssid, w.rssi_dbm, w.channel_number, w.channel_band FROM inst i
        ASOF LEFT JOIN wifi w ON w.session_id = i.session_id AND i.at_us >= w.at_us""",
    "asof2": """SELECT i.*, s.seq AS scan_seq, s.n_neighbors FROM asof1 i
        ASOF LEFT JOIN scans s ON s.session_id = i.session_id AND i.at_us >= s.at_us""",
    "pairs": "SELECT DISTINCT session_id, wifi_seq, scan_seq, ssid, bssid, channel_number FROM asof2",
    "pair_aps": """SELECT p.session_id, p.wifi_seq, p.scan_seq, c.ap_count FROM pairs p JOIN chan c
        ON c.session_id = p.session_id AND c.scan_seq = p.scan_seq AND c.channel_number = p.channel_number""",
    "pair_alt": """SELECT p.session_id, p.wifi_seq, p.scan_seq, n.bssid AS alt_bssid, n.rssi_dbm AS alt_rssi FROM pairs p
        JOIN neighbors n ON n.session_id = p.session_id AND n.scan_seq = p.scan_seq AND n.ssid = p.ssid AND n.bssid <> p.bssid
        QUALIFY row_number() OVER (PARTITION BY p.session_id, p.wifi_seq, p.scan_seq ORDER BY n.rssi_dbm DESC, n.pos) = 1""",
    "asof3": """SELECT i.*, coalesce(a.ap_count, 0) AS channel_aps, b.alt_bssid, b.alt_rssi FROM asof2 i
        LEFT JOIN pair_aps a USING (session_id, wifi_seq, scan_seq) LEFT JOIN pair_alt b USING (session_id, wifi_seq, scan_seq)""",
    "asof4": """SELECT i.*, g.n AS gw_n, g.loss AS gw_loss, g.median_ms AS gw_median_ms, g.p95_ms AS gw_p95_ms,
        g.elevated AS gw_elevated, g.target FROM asof3 i ASOF LEFT JOIN gww g ON g.session_id = i.session_id AND i.at_us >= g.at_us""",
    "asof5": """SELECT i.*, d.n AS dns_n, d.fail AS dns_fail, d.median_ms AS dns_median_ms FROM asof4 i
        ASOF LEFT JOIN dnsw d ON d.session_id = i.session_id AND i.at_us >= d.at_us""",
    "sig_any": """SELECT a.session_id, a.at_us, a.lost, a.epoch, a.identity_key, a.since_us, s.samples FROM assoc a
        LEFT JOIN sigw s ON s.seq = a.seq""",
    "asof6": """SELECT i.*, CASE WHEN NOT a.lost THEN a.epoch END AS sig_epoch, CASE WHEN NOT a.lost THEN a.identity_key END AS identity_key,
        CASE WHEN NOT a.lost THEN a.since_us END AS since_us, a.samples AS sig_samples FROM asof5 i
        ASOF LEFT JOIN sig_any a ON a.session_id = i.session_id AND i.at_us >= a.at_us""",
    "tput_any": """SELECT session_id, at_us, rx_bps, tx_bps FROM tput UNION ALL SELECT session_id, at_us, NULL, NULL FROM iface_lost""",
    "asof7": """SELECT i.*, t.rx_bps, t.tx_bps FROM asof6 i
        ASOF LEFT JOIN tput_any t ON t.session_id = i.session_id AND i.at_us >= t.at_us""",
    "scanw": f"""SELECT session_id, seq, at_us, n_neighbors AS ap_count,
        count(*) OVER (PARTITION BY session_id ORDER BY at_us {_within(300)}) AS samples FROM scans""",
    "asof8": """SELECT i.*, t.ap_count, t.samples AS env_samples FROM asof7 i
        ASOF LEFT JOIN scanw t ON t.session_id = i.session_id AND i.at_us >= t.at_us""",
    "sig_d": f"""SELECT i.session_id, i.at_us, i.is_tick, i.seq,
        count(*) FILTER (s.at_us >= i.at_us - {45 * U}) AS rn, sum(s.rssi_dbm) FILTER (s.at_us >= i.at_us - {45 * U}) AS rs,
        count(*) FILTER (s.at_us < i.at_us - {45 * U}) AS pn, sum(s.rssi_dbm) FILTER (s.at_us < i.at_us - {45 * U}) AS ps
        FROM asof6 i JOIN sigw s ON s.session_id = i.session_id AND s.epoch = i.sig_epoch AND s.at_us <= i.at_us
        AND s.at_us >= i.at_us - {90 * U} GROUP BY ALL""",
    "env_d": f"""SELECT i.session_id, i.at_us, i.is_tick, i.seq,
        count(*) FILTER (s.at_us >= i.at_us - {60 * U}) AS rn, sum(s.n_neighbors) FILTER (s.at_us >= i.at_us - {60 * U}) AS rs,
        count(*) FILTER (s.at_us < i.at_us - {60 * U}) AS pn, sum(s.n_neighbors) FILTER (s.at_us < i.at_us - {60 * U}) AS ps
        FROM inst i JOIN scans s ON s.session_id = i.session_id AND s.at_us <= i.at_us
        AND s.at_us >= i.at_us - {120 * U} GROUP BY ALL""",
    "tl": """SELECT i.*, CASE WHEN a.rn >= 2 AND a.pn >= 2 THEN a.rs / CAST(a.rn AS DOUBLE) - a.ps / CAST(a.pn AS DOUBLE) END AS rssi_delta,
        CASE WHEN b.rn >= 2 AND b.pn >= 2 THEN b.rs / CAST(b.rn AS DOUBLE) - b.ps / CAST(b.pn AS DOUBLE) END AS density_delta
        FROM asof8 i LEFT JOIN sig_d a USING (session_id, at_us, is_tick, seq) LEFT JOIN env_d b USING (session_id, at_us, is_tick, seq)""",
}

KEY = "session_id, at_us, is_tick, seq"


def _rule(kind: str, where: str, fp: str, conf: str, headline: str, evidence: list[str]) -> str:
    return (
        f"SELECT {KEY}, '{kind}' AS kind, {fp} AS fingerprint, CAST({_f32(conf)} AS DOUBLE) AS confidence, "
        f"{headline} AS headline, concat_ws(' | ', {', '.join(evidence)}) AS evidence FROM tl WHERE {where}"
    )


_JIT = "(CASE WHEN gw_median_ms > 0 THEN gw_p95_ms / gw_median_ms ELSE 1e0 END)"
_IDLE = "coalesce(greatest(rx_bps, tx_bps) < 50000, true)"
_DM = "coalesce(dns_median_ms, 0e0)"
_HEALTHY = f"(coalesce(gw_loss, {_f32('0')}) < {_f32('0.10')} AND coalesce(gw_median_ms, 0e0) < 80 AND coalesce(gw_n, 0) >= 3)"
_GAIN = "(alt_rssi - rssi_dbm)"
_PEAK = "(CASE WHEN rx_bps IS NULL THEN NULL ELSE greatest(rx_bps, tx_bps) END)"

RULES = {
    "rf_congestion": _rule(
        "RfCongestion", "channel_number IS NOT NULL AND channel_aps >= 6", "'rf_congestion:ch' || channel_number",
        "CASE WHEN channel_aps <= 8 THEN 0.55 ELSE 0.8 END",
        f"format('Local RF congestion {{}} on channel {{}} ({{}} APs share the channel)', {_tier('channel_aps')}, channel_number, channel_aps)",
        ["format('APs on connected channel ({}): {}', channel_number, channel_aps)",
         "format('Total visible APs: {}', coalesce(n_neighbors, 0))", f"'Local pressure tier: ' || {_tier('channel_aps')}"],
    ),
    "gateway_instability": _rule(
        "GatewayInstability",
        f"gw_n >= 5 AND gw_median_ms IS NOT NULL AND NOT (gw_loss < {_f32('0.05')} AND {_JIT} < 4) "
        f"AND NOT (gw_elevated <= 1 AND {_IDLE} AND gw_loss < {_f32('0.05')})",
        "'gateway_instability:' || target",
        _clamp(f"CAST(gw_loss AS DOUBLE) * 1.5e0 + least({_JIT} - 1e0, 5e0) * 0.1e0", "0", "0.95"),
        f"format('Gateway {{}} unstable: {{:.0f}}% loss, p95 {{:.0f}} ms vs median {{:.0f}} ms', target, {_f32('gw_loss * ' + _f32('100'))}, gw_p95_ms, gw_median_ms)",
        ["format('Loss ratio: {:.2f}', gw_loss)", "format('Median RTT: {:.1f} ms', gw_median_ms)",
         "format('p95 RTT: {:.1f} ms', gw_p95_ms)",
         "format('Elevated samples (>2.0× median): {}/{}', gw_elevated, gw_n)",
         f"format('Link recently {{}} (rolling RX/TX peak {{}})', CASE WHEN {_IDLE} THEN 'idle' ELSE 'active' END, {_peak(_PEAK)})"],
    ),
    "dns_pathology": _rule(
        "DnsPathology", f"dns_n >= 4 AND (dns_fail >= {_f32('0.25')} OR {_DM} >= 150)", "'dns_pathology'",
        f"CASE WHEN {_HEALTHY} THEN {_clamp('CAST(dns_fail AS DOUBLE) * 1.5e0 + ' + _DM + ' / 1e3', '0.3', '0.9')} "
        f"ELSE {_clamp('CAST(dns_fail AS DOUBLE) + ' + _DM + ' / 2e3', '0.15', '0.55')} END",
        f"format('DNS pathology: {{:.0f}}% failures, median {{:.0f}} ms', {_f32('dns_fail * ' + _f32('100'))}, {_DM})",
        ["format('DNS failure ratio: {:.2f}', dns_fail)", f"format('DNS median RTT: {{:.1f}} ms', {_DM})",
         f"'Gateway looks healthy: ' || {_HEALTHY}", "format('DNS samples in window: {}', dns_n)"],
    ),
    "sticky_client": _rule(
        "StickyClient", f"rssi_dbm <= -70 AND ssid IS NOT NULL AND bssid IS NOT NULL AND {_GAIN} >= 10", "'sticky_client:' || ssid",
        f"CASE WHEN {_GAIN} >= 20 THEN 0.8 WHEN {_GAIN} >= 15 THEN 0.6 ELSE 0.4 END",
        "format('Sticky client suspected: holding {} dBm while {} is {} dBm', rssi_dbm, alt_bssid, alt_rssi)",
        ["format('Current AP RSSI: {} dBm', rssi_dbm)", "format('Strongest same-SSID neighbor RSSI: {} dBm', alt_rssi)",
         f"format('Delta: {{}} dB', {_GAIN})"],
    ),
    "signal_trend": _rule(
        "SignalTrend", "abs(rssi_delta) >= 5", "format('signal_trend:{}:{}', identity_key, CASE WHEN rssi_delta < 0 THEN 'degrading' ELSE 'recovering' END)",
        _clamp("abs(rssi_delta) / 15e0", "0.3", "0.85"),
        "format('Signal quality {} ({:+.0f} dB over 90s)', CASE WHEN rssi_delta < 0 THEN 'deteriorating' ELSE 'recovering' END, rssi_delta)",
        ["format('RSSI Δ over 90s: {:+.1f} dB', rssi_delta)", "format('Samples in window: {}', sig_samples)",
         f"format('Connected for: {{}}s', greatest(0, {_secs('at_us - since_us')}))"],
    ),
    "rf_density_trend": _rule(
        "RfDensityTrend", "abs(density_delta) >= 3", "'rf_density_trend:' || CASE WHEN density_delta > 0 THEN 'rising' ELSE 'falling' END",
        _clamp("abs(density_delta) / 10e0", "0.3", "0.8"),
        "format('Ambient RF density {} ({:+.0f} APs over 120s, now {})', CASE WHEN density_delta > 0 THEN 'rising' ELSE 'falling' END, density_delta, ap_count)",
        ["format('Mean AP-count Δ: {:+.1f}', density_delta)", "format('Current AP count: {}', ap_count)",
         "format('Scan samples in window: {}', env_samples)"],
    ),
}
FRAGMENTS |= {
    "cand": " UNION ALL ".join(RULES.values()),
    # Lifecycle.  Instants are numbered once, so "later" is one integer.
    "num": f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_us, is_tick, seq) AS i FROM inst",
    "c0": """SELECT c.*, CAST(c.confidence AS FLOAT) AS cf, n.i, lead(n.i) OVER (PARTITION BY c.session_id, fingerprint ORDER BY n.i) AS next_i
        FROM cand c JOIN num n USING (session_id, at_us, is_tick, seq)""",
    "c1": f"""SELECT c.*, e.i AS end_i, e.at_us AS end_at, e.is_tick AS end_tick, e.seq AS end_seq FROM (SELECT *, at_us + {20 * U} AS due FROM c0) c
        ASOF LEFT JOIN num e ON e.session_id = c.session_id AND c.due <= e.at_us""",
    "c2": "SELECT *, end_i IS NOT NULL AND (next_i IS NULL OR end_i < next_i) AS ends FROM c1",
    "c3": """SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY session_id, fingerprint ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM c2""",
    "c4": """SELECT *, max(cf) OVER w AS peak, min(at_us) OVER w AS first_seen, row_number() OVER w AS nth FROM c3
        WINDOW w AS (PARTITION BY session_id, fingerprint, ep ORDER BY i)""",
    "nxt": f"""SELECT a.session_id, a.fingerprint, a.ep, a.i, min(b.i) AS j FROM c4 a JOIN c4 b ON a.session_id = b.session_id
        AND a.fingerprint = b.fingerprint AND a.ep = b.ep AND b.at_us >= a.at_us + {15 * U} AND b.i > a.i
        AND abs(b.cf - a.cf) >= {_f32('0.15')} GROUP BY ALL""",
    "chain": """SELECT session_id, fingerprint, ep, i, CAST(NULL AS FLOAT) AS before FROM c4 WHERE nth = 1
        UNION ALL SELECT n.session_id, n.fingerprint, n.ep, n.j, o.cf FROM chain h JOIN nxt n USING (session_id, fingerprint, ep, i)
        JOIN c4 o ON o.session_id = h.session_id AND o.fingerprint = h.fingerprint AND o.i = h.i""",
    "find": """SELECT c.session_id, c.at_us, c.is_tick, c.seq, kind, fingerprint, CAST(cf AS DOUBLE) AS confidence, CAST(peak AS DOUBLE) AS peak_confidence,
        CASE WHEN before IS NULL THEN 'Active' WHEN cf > before THEN 'Escalating' ELSE 'Recovering' END AS lifecycle,
        first_seen AS first_seen_us, c.at_us AS last_seen_us,
        headline || CASE WHEN before IS NULL THEN '' WHEN cf > before THEN ' — worsening' ELSE ' — easing' END AS headline, evidence
        FROM c4 c JOIN chain USING (session_id, fingerprint, ep, i)
        UNION ALL SELECT session_id, end_at, end_tick, end_seq, kind, fingerprint, 0e0, CAST(peak AS DOUBLE), 'Resolved', first_seen, end_at,
        headline || ' — resolved', evidence FROM c4 WHERE ends""",
    "act": """SELECT * FROM find QUALIFY row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY at_us DESC, is_tick DESC, seq DESC) = 1""",
    "active": "SELECT * FROM act WHERE lifecycle <> 'Resolved'",
    # landmarks
    "m_find": """SELECT f.session_id, l.seq AS commit_seq, l.seq, f.at_us, 'Finding' AS category,
        CASE WHEN lifecycle IN ('Active', 'Escalating') THEN 'Alarm' ELSE 'Recovery' END AS severity, lifecycle || ' · ' || headline AS headline
        FROM find f ASOF JOIN log l ON l.session_id = f.session_id AND f.at_us >= l.at_us""",
    "hchg": """SELECT session_id, seq, at_us, sensor, state, lag(state) OVER (PARTITION BY session_id, sensor ORDER BY seq) AS prev_state
        FROM health QUALIFY prev_state IS DISTINCT FROM state""",
    "m_health": """SELECT session_id, seq AS commit_seq, seq, at_us, 'Health' AS category,
        CASE WHEN state = 'Operational' THEN 'Recovery' ELSE 'Alarm' END AS severity,
        CASE WHEN state = 'Operational' THEN sensor || ' recovered (was ' || prev_state || ')' ELSE sensor || ' → ' || state END AS headline
        FROM hchg WHERE prev_state IS NOT NULL OR state <> 'Operational'""",
    "stance": """SELECT g.*, CASE WHEN NOT reachable THEN 'unreachable' WHEN rtt_ms > median_ms * 1.5e0 + 5e0 THEN 'spiking' ELSE 'stable' END AS stance,
        s.at_us AS active_us FROM rmed g ASOF LEFT JOIN (SELECT * FROM step WHERE regime <> 'idle') s
        ON s.session_id = g.session_id AND g.at_us >= s.at_us""",
    "gr0": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - row_number() OVER (PARTITION BY session_id, stance ORDER BY seq) AS grp FROM stance""",
    "gr1": """SELECT session_id, stance, grp, min(seq) AS s_seq, list(seq ORDER BY seq)[3] AS c_seq, count(*) AS n FROM gr0 GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "gr2": "SELECT *, lag(stance) OVER (PARTITION BY session_id ORDER BY c_seq) AS prev FROM gr1",
    "gr3": f"""SELECT r.session_id, r.c_seq, r.stance, s.seq, s.at_us, c.target || format(' {{:.1f}} ms', s.rtt_ms) AS reading, c.target,
        coalesce({_secs('c.at_us - c.active_us')} >= 15, true) AS waking FROM gr2 r JOIN stance s ON s.seq = r.s_seq JOIN stance c ON c.seq = r.c_seq
        WHERE (prev IS NULL AND r.stance <> 'stable') OR prev <> r.stance""",
    "m_gw": """SELECT session_id, c_seq AS commit_seq, seq, at_us, 'Gateway' AS category,
        CASE WHEN stance = 'stable' THEN 'Recovery' WHEN stance = 'spiking' AND waking THEN 'Notable' ELSE 'Alarm' END AS severity,
        CASE WHEN stance = 'stable' THEN 'Gateway recovered · ' || reading WHEN stance = 'spiking' AND waking THEN
        'Gateway latency rose · ' || reading || ' · wakeup likely' WHEN stance = 'spiking' THEN 'Gateway spiking · ' || reading
        ELSE 'Gateway unreachable · ' || target END AS headline FROM gr3""",
    "dflip": "SELECT *, lag(answered) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM dns QUALIFY was <> answered",
    "m_dns": """SELECT session_id, seq AS commit_seq, seq, at_us, 'Dns' AS category, CASE WHEN answered THEN 'Recovery' ELSE 'Alarm' END AS severity,
        CASE WHEN answered THEN 'DNS recovered · ' || query || ' via ' || resolver
        ELSE 'DNS failing · ' || query || ' via ' || resolver || ' (' || error || ')' END AS headline FROM dflip""",
    "tr0": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - row_number() OVER (PARTITION BY session_id, regime ORDER BY seq) AS grp FROM step""",
    "tr1": "SELECT *, min(at_us) OVER (PARTITION BY session_id, regime, grp) AS start_us FROM tr0",
    "tr2": f"""SELECT session_id, regime, grp, min(seq) AS s_seq, min(seq) FILTER ({_secs('at_us - start_us')} >= 10) AS c_seq FROM tr1
        GROUP BY 1, 2, 3 HAVING c_seq IS NOT NULL""",
    "tr3": "SELECT *, lag(regime) OVER (PARTITION BY session_id ORDER BY c_seq) AS prev FROM tr2",
    "m_tput": f"""SELECT r.session_id, c_seq AS commit_seq, s.seq, s.at_us, 'Throughput' AS category,
        CASE WHEN r.regime IN ('sustained', 'bursting') THEN 'Notable' ELSE 'Recovery' END AS severity,
        'Throughput ' || replace(coalesce(prev, r.regime), 'trickle', 'trickling') || ' → ' || replace(r.regime, 'trickle', 'trickling') || ' · RX ' ||
        {_rate('s.rx_bps')} || ' / TX ' || {_rate('s.tx_bps')} AS headline FROM tr3 r JOIN step s ON s.seq = r.s_seq
        WHERE (prev IS NULL AND r.regime IN ('sustained', 'bursting')) OR (prev <> 'bursting' AND r.regime = 'bursting')
        OR (prev IN ('idle', 'trickle') AND r.regime = 'sustained') OR (prev IN ('sustained', 'bursting') AND r.regime = 'idle')""",
    "all_marks": "SELECT * FROM marks UNION ALL SELECT * FROM m_find",
    "marks": "SELECT * FROM m_health UNION ALL SELECT * FROM m_gw UNION ALL SELECT * FROM m_dns UNION ALL SELECT * FROM m_tput",
    "ph": """SELECT l.session_id, max(seq) AS playhead_seq, arg_max(at_us, seq) AS playhead_us FROM log l JOIN ends e
        ON e.session_id = l.session_id AND l.seq <= (first_seq + last_seq) // 2 GROUP BY 1""",
    # latest scan and link
    "lscan": "SELECT session_id, max(seq) AS scan_seq FROM scans GROUP BY 1",
    "lwifi": "SELECT * FROM wifi QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1",
    "occ": f"""SELECT session_id, scan_seq, {_band_rank('channel_band', 'channel_number')} AS band_rank, channel_number AS number, count(*) AS ap_count
        FROM neighbors GROUP BY ALL""",
    "slink": f"""SELECT s.session_id, s.seq, s.at_us, CASE WHEN w.channel_number IS NOT NULL THEN {_band_rank('w.channel_band', 'w.channel_number')} END AS band_rank,
        w.channel_number AS number FROM scans s ASOF LEFT JOIN wifi w ON w.session_id = s.session_id AND s.at_us >= w.at_us""",
    # cards
    "gh": "SELECT * FROM gateway QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 240",
    "gc": f"""SELECT session_id, coalesce({_med('l')}, 0e0) AS med, coalesce({_p95('l')}, 0e0) AS p95, bad, n FROM (SELECT session_id,
        list(rtt_ms) FILTER (reachable) AS l, count(*) FILTER (NOT reachable) AS bad, count(*) AS n FROM gh GROUP BY 1)""",
    "gs": """SELECT h.*, med, CASE WHEN NOT reachable THEN 'unreachable' WHEN rtt_ms > med * 1.5e0 + 5e0 THEN 'spiking' ELSE 'stable' END AS cls
        FROM gh h JOIN gc USING (session_id)""",
    "dh": "SELECT *, CASE WHEN answered THEN 'answering' ELSE 'failing' END AS cls FROM dns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 240",
    "dc": f"""SELECT session_id, coalesce({_med('l')}, 0e0) AS med, bad, n FROM (SELECT session_id, list(rtt_ms) FILTER (answered) AS l,
        count(*) FILTER (NOT answered) AS bad, count(*) AS n FROM dh GROUP BY 1)""",
    "th": f"""SELECT t.*, {_regime('step_rx_bps', 'step_tx_bps')} AS cls FROM tput t WHERE step_rx_bps IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM iface_lost l WHERE l.session_id = t.session_id AND l.seq > t.seq)
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 300""",
}


def _held(source: str) -> str:
    """Per session: last class, and whole seconds it has held."""
    return f"""SELECT session_id, cls, CASE WHEN s >= 3 THEN s END AS held FROM (SELECT session_id, last_cls AS cls,
        {_secs("max(at_us) - min(at_us)")} AS s FROM (SELECT h.*, x.last_cls, max(CASE WHEN h.cls <> x.last_cls THEN h.seq END) OVER (PARTITION BY h.session_id) AS broke
        FROM {source} h JOIN (SELECT session_id, arg_max(cls, seq) AS last_cls FROM {source} GROUP BY 1) x USING (session_id))
        WHERE broke IS NULL OR seq > broke GROUP BY 1, 2)"""


FRAGMENTS |= {"g_held": _held("gs"), "d_held": _held("dh"), "t_held": _held("th")}


def _loss_pct(bad: str, n: str) -> str:
    return _f32(f"CAST({_f32(bad + ' * 100')} AS DOUBLE) / {n}")


def _gw_card(gh: str = "gh", gc: str = "gc", held: str = "g_held") -> str:
    return f"""SELECT c.session_id, x.target, x.last, med AS median_ms, p95 AS p95_ms, CAST({_loss_pct('bad', 'n')} AS DOUBLE) AS loss_pct,
        {_quality(_good('med', '5', '40'))} AS quality, CASE WHEN held IS NOT NULL THEN cls || ' ' || {_dur('held')} END AS stance
        FROM {gc} c JOIN {held} USING (session_id) JOIN (SELECT session_id, arg_max(target, seq) AS target,
        arg_max(CASE WHEN reachable THEN format('{{:.1f}} ms', rtt_ms) ELSE 'unreachable' END, seq) AS last FROM {gh} GROUP BY 1) x USING (session_id)"""


_LABEL = f"CASE WHEN {{x}} >= {_f32('0.7')} THEN 'bad' WHEN {{x}} >= {_f32('0.4')} THEN 'warn' ELSE 'info' END"
_ACTIVE_SECS = f"greatest(0, {_secs('last_seen_us - first_seen_us')})"
_SUMMARY = ", ".join(
    f"count(*) FILTER (event_type = '{v}') AS {n}"
    for v, n in [("Wifi", "wifi"), ("Scan", "scan"), ("GatewayLatency", "gateway"), ("DnsLatency", "dns"), ("InterfaceCounters", "iface"),
                 ("InterfaceStateChanged", "iface_state"), ("RoamDetected", "roam"), ("Finding", "findings"), ("SensorHealth", "health")]
)
_TALLY = ["wifi", "scan", "gateway", "dns", "iface", "findings", "health"]


def _delta_join(src: str, value: str, half: int, full: int, keys: str) -> str:
    return f"""SELECT a.seq, CASE WHEN count(*) FILTER (b.at_us >= a.at_us - {half * U}) >= 2 AND count(*) FILTER (b.at_us < a.at_us - {half * U}) >= 2 THEN
        sum(b.{value}) FILTER (b.at_us >= a.at_us - {half * U}) / CAST(count(*) FILTER (b.at_us >= a.at_us - {half * U}) AS DOUBLE) -
        sum(b.{value}) FILTER (b.at_us < a.at_us - {half * U}) / CAST(count(*) FILTER (b.at_us < a.at_us - {half * U}) AS DOUBLE) END AS d
        FROM {src} a JOIN {src} b ON {keys} AND b.at_us <= a.at_us AND b.at_us >= a.at_us - {full * U} GROUP BY a.seq"""


_SAME_EPOCH = "a.session_id = b.session_id AND a.epoch = b.epoch"
_COVER = f"""SELECT w.session_id, w.source, CASE WHEN s.first_us IS NOT NULL THEN greatest(0, {_secs('s.last_us - s.first_us')}) END AS span_secs,
    coalesce(s.state <> 'Operational', false) AS degraded,
    coalesce(s.state <> 'Operational', false) OR coalesce({_secs('s.last_us - s.first_us')} >= 30, false) AS satisfied
    FROM (SELECT DISTINCT session_id, unnest(['gateway', 'dns', 'iface', 'wifi']) AS source FROM log) w LEFT JOIN (
    SELECT session_id, source, min(at_us) FILTER (event_type <> 'SensorHealth') AS first_us, max(at_us) FILTER (event_type <> 'SensorHealth') AS last_us,
    arg_max(health_state, seq) FILTER (event_type = 'SensorHealth') AS state FROM log GROUP BY 1, 2) s USING (session_id, source)"""
FRAGMENTS["cover"] = _COVER
_LINK_NOW = "SELECT session_id, arg_max(at_us, seq) AS now_us FROM log GROUP BY 1"


def _link_card(assoc: str, wifi: str, now: str) -> str:
    """Link, association and drift at the end of the given streams."""
    return f"""SELECT w.session_id, w.ssid, w.bssid, w.rssi_dbm, w.rssi_dbm - w.noise_dbm AS snr_db, {_quality(_rssi_good('w.rssi_dbm'))} AS quality,
        CASE WHEN NOT a.lost THEN greatest(0, {_secs('now_us - a.since_us')}) END AS held_secs, n.now_us, a.epoch, a.lost
        FROM (SELECT * FROM {wifi} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1) w
        JOIN ({now}) n USING (session_id) JOIN (SELECT * FROM {assoc} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1) a
        ON a.session_id = w.session_id"""


FRAGMENTS["lc0"] = _link_card("assoc", "wifi", _LINK_NOW)
FRAGMENTS["lc1"] = f"""SELECT l.session_id, count(*) FILTER (r.at_us >= now_us - {30 * U}) AS rn, sum(r.rssi_dbm) FILTER (r.at_us >= now_us - {30 * U}) AS rs,
    count(*) FILTER (r.at_us < now_us - {30 * U}) AS pn, sum(r.rssi_dbm) FILTER (r.at_us < now_us - {30 * U}) AS ps FROM lc0 l
    JOIN (SELECT * FROM assoc QUALIFY row_number() OVER (PARTITION BY session_id, epoch ORDER BY seq DESC) <= 90) r
    ON r.session_id = l.session_id AND r.epoch = l.epoch AND NOT l.lost AND r.at_us >= now_us - {60 * U} GROUP BY 1"""
FRAGMENTS["lc2"] = """SELECT l.*, CASE WHEN rn >= 2 AND pn >= 2 THEN rs / CAST(rn AS DOUBLE) - ps / CAST(pn AS DOUBLE) END AS delta
    FROM lc0 l LEFT JOIN lc1 USING (session_id)"""

# waterfall
FRAGMENTS |= {
    "wf_scan": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS col FROM (SELECT * FROM slink
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 12)""",
    "wf_cnt": "SELECT o.session_id, s.col, o.band_rank, o.number, o.ap_count FROM occ o JOIN wf_scan s ON s.session_id = o.session_id AND s.seq = o.scan_seq",
    "wf_ch": """SELECT session_id, band_rank, number, sum(ap_count) AS total, max(linked) AS linked FROM (
        SELECT session_id, band_rank, number, ap_count, NULL AS linked FROM wf_cnt UNION ALL
        SELECT session_id, band_rank, number, 0, col FROM wf_scan WHERE number IS NOT NULL) GROUP BY 1, 2, 3""",
    "wf_pick": """SELECT *, count(*) OVER (PARTITION BY session_id) <= 4 OR row_number() OVER (PARTITION BY session_id ORDER BY linked DESC NULLS LAST,
        CASE WHEN linked IS NULL THEN total END DESC NULLS LAST, band_rank, number) <= 3 AS kept FROM wf_ch""",
    "wf_rows": """SELECT DISTINCT session_id, NOT kept AS is_other, CASE WHEN kept THEN band_rank END AS band_rank, CASE WHEN kept THEN number END AS number,
        count(*) FILTER (NOT kept) OVER (PARTITION BY session_id) AS hidden_channels FROM wf_pick""",
}

QUERIES: dict[str, str] = {
    "event_index": "SELECT session_id, seq, at_us, event_type, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS event_index FROM log",
    "typed_views": " UNION ALL ".join(
        f"SELECT session_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, '{v}' AS view FROM {v} GROUP BY 1"
        for v in ("gateway", "dns", "wifi", "scans", "counters", "health")
    ),
    "deduplicate": "SELECT session_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM log GROUP BY 1",
    "assign_ids": "SELECT session_id, seq, at_us, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS id FROM log",
    "backlog": "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 100",
    "link_ladders": f"""SELECT session_id, seq, at_us, 'Wifi' AS category, lower(bssid) AS bssid, {_band('channel_number')} AS band,
        CASE WHEN channel_band = 'Unknown' THEN {_band('channel_number')} ELSE channel_band END AS settled_band, rssi_dbm - noise_dbm AS snr_db,
        CAST({_rssi_good('rssi_dbm')} AS DOUBLE) AS goodness, {_quality(_rssi_good('rssi_dbm'))} AS quality FROM wifi""",
    "latency_ladders": f"""SELECT session_id, seq, at_us, rtt_ms, {_clamp('rtt_ms / 100e0', '0', '1')} AS clamped,
        CAST({_good('rtt_ms', '5', '40')} AS DOUBLE) AS gateway_goodness, CAST({_good('rtt_ms', '15', '150')} AS DOUBLE) AS dns_goodness,
        {_quality(_good('rtt_ms', '5', '40'))} AS quality, {_LABEL.format(x=_f32('rtt_ms / 100e0'))} AS label,
        CASE WHEN NOT reachable THEN 'unreachable' WHEN rtt_ms > 35 THEN 'spiking' ELSE 'stable' END AS stance FROM gateway""",
    "number_text": f"""SELECT session_id, seq, at_us, {_rate('(rx_bytes / 1e3)')} AS rate, {_rate('(rx_bytes * 64e0)')} AS fast_rate,
        {_peak('(rx_bytes / 1e3)')} AS peak, {_bytes('rx_bytes')} AS bytes,
        {_dur('CAST(floor(rx_bytes / 1e3 / 100) AS BIGINT)')} AS short_duration, {_dur('CAST(floor(rx_bytes / 1e3 / 100) AS BIGINT)', True)} AS long_duration,
        format('{{:+.2f}}', rx_bytes / 1e3 - 12345.675e0) AS signed FROM counters""",
    "event_feed": f"""SELECT session_id, seq, at_us, 'Wifi' AS category, 'wifi   ' || ssid || ' @ ' || rssi_dbm || ' dBm' AS line FROM wifi UNION ALL
        SELECT session_id, seq, at_us, 'Wifi', 'scan   ' || n_neighbors || ' neighbor APs' FROM scans UNION ALL
        SELECT session_id, seq, at_us, 'Gateway', CASE WHEN reachable THEN format('gw     {{}} via {{}}: {{:.1f}} ms', target, probe, rtt_ms)
        ELSE 'gw     ' || target || ' unreachable' END FROM gateway UNION ALL
        SELECT session_id, seq, at_us, 'Dns', CASE WHEN answered THEN format('dns    {{}}: {{:.0f}} ms via {{}}', query, rtt_ms, resolver)
        ELSE 'dns    ' || query || ' FAILED: ' || error END FROM dns UNION ALL
        SELECT session_id, seq, at_us, 'Interface', 'iface  ' || interface || ' rx=' || {_bytes('rx_bytes')} || ' tx=' || {_bytes('tx_bytes')}
        || ' err=' || rx_errors || '/' || tx_errors FROM counters UNION ALL
        SELECT session_id, seq, at_us, 'Health', 'health ' || sensor || ' → ' || state || ' via lens' FROM health""",
    "gateway_window": "SELECT * REPLACE (CAST(loss AS DOUBLE) AS loss) FROM gww",
    "dns_window": "SELECT * REPLACE (CAST(fail AS DOUBLE) AS fail) FROM dnsw",
    "association_epochs": "SELECT session_id, seq, at_us, lost, epoch, since_us, identity_key FROM assoc",
    "signal_window": f"""SELECT s.*, r.d AS rssi_delta, c.d AS card_delta FROM sigw s LEFT JOIN ({_delta_join('sigw', 'rssi_dbm', 45, 90, _SAME_EPOCH)}) r USING (seq)
        LEFT JOIN ({_delta_join('sigw', 'rssi_dbm', 30, 60, _SAME_EPOCH)}) c USING (seq)""",
    "density_window": f"""SELECT w.*, d.d AS density_delta FROM scanw w LEFT JOIN ({_delta_join('scans', 'n_neighbors', 60, 120, 'a.session_id = b.session_id')}) d USING (seq)""",
    "counter_epochs": "SELECT session_id, seq, at_us, lost, epoch FROM cnt",
    "throughput_window": "SELECT * FROM tput",
    "rolling_median": "SELECT session_id, seq, at_us, rtt_ms, median_ms FROM rmed",
    "step_rate": "SELECT * FROM step",
    "last_n": "SELECT session_id, seq, at_us, rtt_ms FROM gateway QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 30",
    "series_stats": f"""SELECT session_id, count(*) AS n, min(at_us) AS earliest_us, max(at_us) AS latest_us, max(rtt_ms) AS max_value,
        avg(rtt_ms) FILTER (at_us >= now_us - {30 * U}) AS mean_recent,
        CASE WHEN count(*) >= 2 THEN {_secs('max(at_us) - min(at_us)')} END AS span_secs FROM (SELECT *, max(at_us) OVER (PARTITION BY session_id) AS now_us
        FROM gateway QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 30) GROUP BY 1""",
    "elapsed_since_last": f"SELECT g.session_id, greatest(0, {_secs('e.last_us - max(g.at_us)')}) AS elapsed_secs FROM gateway g JOIN ends e USING (session_id) GROUP BY 1, e.last_us",
    "evaluation_instants": "SELECT * FROM inst",
    "timeline": """SELECT session_id, at_us, is_tick, seq, gw_n, CAST(gw_loss AS DOUBLE) AS gw_loss, gw_median_ms, gw_p95_ms, gw_elevated, dns_n,
        CAST(dns_fail AS DOUBLE) AS dns_fail, dns_median_ms, ssid, bssid, rssi_dbm, channel_number, scan_seq,
        CASE WHEN wifi_seq IS NULL AND scan_seq IS NULL THEN NULL ELSE channel_aps END AS channel_aps, alt_bssid, alt_rssi, identity_key, since_us, sig_samples, ap_count, env_samples, rx_bps, tx_bps, rssi_delta, density_delta FROM tl""",
    "last_active": f"""SELECT session_id, seq, at_us, stance, {_secs('at_us - active_us')} AS idle_secs,
        coalesce({_secs('at_us - active_us')} >= 15, true) AS link_was_idle FROM stance""",
    "scan_link_channel": "SELECT * FROM slink",
    "link_neighbors": """SELECT session_id, seq, at_us, ssid, bssid, scan_seq, channel_aps, alt_bssid, alt_rssi FROM asof3
        WHERE is_tick = 0 AND seq IN (SELECT seq FROM wifi UNION ALL SELECT seq FROM scans)""",
    "landmarks_around_playhead": """SELECT session_id, playhead_seq, count(*) FILTER (o < coalesce(first_past, 1e9)) - 1 AS current_index,
        arg_max(seq, o) FILTER (o < coalesce(first_past, 1e9)) AS current_seq, arg_min(seq, o) FILTER (seq > playhead_seq) AS next_seq,
        arg_max(seq, o) FILTER (seq < playhead_seq) AS prev_seq FROM (SELECT *, min(CASE WHEN seq > playhead_seq THEN o END) OVER (PARTITION BY session_id) AS first_past
        FROM (SELECT m.*, playhead_seq, row_number() OVER (PARTITION BY m.session_id ORDER BY commit_seq, category) AS o FROM all_marks m JOIN ph USING (session_id))) GROUP BY 1, 2""",
    "session_summary": f"""SELECT session_id, count(*) AS envelope_count, min(at_us) AS first_us, max(at_us) AS last_us, {_SUMMARY},
        {_secs('max(at_us) - min(at_us)')} AS duration_secs, {_dur(_secs('max(at_us) - min(at_us)'), True)} AS duration_text FROM log GROUP BY 1""",
    "category_counts": """SELECT session_id, CASE event_type WHEN 'Wifi' THEN 'Wifi' WHEN 'Scan' THEN 'Wifi' WHEN 'GatewayLatency' THEN 'Gateway'
        WHEN 'DnsLatency' THEN 'Dns' WHEN 'InterfaceCounters' THEN 'Interface' ELSE 'Health' END AS category, count(*) AS n FROM log GROUP BY 1, 2""",
    "running_tally": f"""SELECT session_id, window_us, {', '.join(f'CAST(sum({n}) OVER (PARTITION BY session_id ORDER BY window_us) AS BIGINT) AS {n}' for n in _TALLY)} FROM (
        SELECT session_id, at_us // {5 * U} * {5 * U} AS window_us, {_SUMMARY} FROM log GROUP BY 1, 2)""",
    "scan_pressure": f"SELECT *, {_tier('ap_count')} AS tier FROM chan",
    "occupancy": "SELECT * FROM occ",
    "coverage": "SELECT * FROM cover",
    "coverage_overall": "SELECT session_id, bool_and(satisfied) AS satisfied FROM cover GROUP BY 1",
    "latency_card": _gw_card(),
    "dns_card": f"""SELECT c.session_id, x.resolver, x.last, med AS median_ms, CAST({_loss_pct('bad', 'n')} AS DOUBLE) AS fail_pct,
        {_quality('least(' + _good('med', '15', '150') + ', ' + _f32('1 - CAST(' + _f32('CAST(' + _loss_pct('bad', 'n') + ' AS DOUBLE) / 100e0') + ' AS DOUBLE)') + ')')} AS quality,
        CASE WHEN held IS NOT NULL THEN cls || ' ' || {_dur('held')} END AS stance FROM dc c JOIN d_held USING (session_id)
        JOIN (SELECT session_id, arg_max(resolver, seq) AS resolver, arg_max(CASE WHEN answered THEN format('{{:.0f}} ms', rtt_ms) ELSE 'FAIL' END, seq) AS last
        FROM dh GROUP BY 1) x USING (session_id)""",
    "latest_counters": """SELECT session_id, seq, interface, rx_bytes, tx_bytes, rx_errors, tx_errors, rx_errors + tx_errors AS total_errors FROM counters c
        WHERE NOT EXISTS (SELECT 1 FROM iface_lost l WHERE l.session_id = c.session_id AND l.seq > c.seq)
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1""",
    **{f"rule_{name}": sql for name, sql in RULES.items()},
    "roams": """SELECT session_id, seq, at_us, ssid, lag(bssid) OVER w AS from_bssid, bssid AS to_bssid, lag(rssi_dbm) OVER w AS from_rssi_dbm, rssi_dbm AS to_rssi_dbm
        FROM wifi WINDOW w AS (PARTITION BY session_id ORDER BY seq) QUALIFY lag(bssid) OVER w <> bssid AND lag(ssid) OVER w IS NOT DISTINCT FROM ssid""",
    "health_changes": "SELECT *, 'lens' AS backend, CAST(NULL AS VARCHAR) AS detail FROM hchg",
    "findings": "SELECT * FROM find",
    "active_findings": "SELECT * FROM active",
    "landmarks_findings": "SELECT * FROM m_find",
    "landmarks_health": "SELECT * FROM m_health",
    "landmarks_gateway": "SELECT * FROM m_gw",
    "landmarks_dns": "SELECT * FROM m_dns",
    "landmarks_throughput": "SELECT * FROM m_tput",
    "landmarks": "SELECT * FROM all_marks",
    "link_card": f"""SELECT session_id, ssid, bssid, rssi_dbm, snr_db, quality, held_secs,
        CASE WHEN held_secs IS NULL THEN '—' ELSE {_dur('held_secs')} END AS held, delta,
        CASE WHEN delta IS NULL THEN '…' WHEN abs(delta) < 1.5 THEN 'stable' ELSE format('{{:+.0f}} dB / 60s', delta) END AS drift FROM lc2""",
    "throughput_card": f"""SELECT t.session_id, n.rx_bps, n.tx_bps, t.cls AS regime, CASE WHEN held IS NOT NULL THEN replace(t.cls, 'trickle', 'trickling') || ' ' || {_dur('held')} END AS stance
        FROM (SELECT * FROM th QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1) t JOIN t_held h USING (session_id)
        JOIN (SELECT session_id, rx_bps, tx_bps FROM tput QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1) n USING (session_id)""",
    "timeline_strip": f"""SELECT c.session_id, c.col, coalesce(n, 0) AS n, ['Notable', 'Recovery', 'Alarm'][worst] AS worst_severity,
        CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' WHEN n <= 3 THEN 'few' ELSE 'many' END AS density
        FROM (SELECT session_id, unnest(range(60)) AS col FROM ends) c LEFT JOIN (SELECT m.session_id,
        least(CAST(floor(((m.at_us - first_us) / {SEC}) / (CAST({_secs('last_us - first_us')} AS DOUBLE) / 60e0)) AS BIGINT), 59) AS col, count(*) AS n,
        max(CASE severity WHEN 'Alarm' THEN 3 WHEN 'Recovery' THEN 2 ELSE 1 END) AS worst
        FROM all_marks m JOIN ends e ON e.session_id = m.session_id AND m.at_us >= e.first_us AND {_secs('last_us - first_us')} > 0 GROUP BY 1, 2) h USING (session_id, col)""",
    "playback_position": f"""SELECT session_id, playhead_seq, {_secs('playhead_us - first_us')} AS elapsed_secs, {_secs('last_us - first_us')} AS total_secs,
        least(CAST(floor(((playhead_us - first_us) / {SEC}) / (CAST({_secs('last_us - first_us')} AS DOUBLE) / 60e0)) AS BIGINT), 59) AS col FROM ph JOIN ends USING (session_id)""",
    "rf_waterfall": """SELECT r.session_id, r.is_other, r.band_rank, r.number, s.col, s.seq AS scan_seq, s.at_us,
        CAST(coalesce((SELECT sum(c.ap_count) FROM wf_cnt c JOIN wf_pick p USING (session_id, band_rank, number) WHERE c.session_id = r.session_id AND c.col = s.col
        AND CASE WHEN r.is_other THEN NOT p.kept ELSE p.band_rank = r.band_rank AND p.number = r.number END), 0) AS BIGINT) AS ap_count,
        coalesce((SELECT bool_or(CASE WHEN r.is_other THEN NOT p.kept ELSE p.band_rank = r.band_rank AND p.number = r.number END) FROM wf_pick p
        WHERE p.session_id = s.session_id AND p.band_rank = s.band_rank AND p.number = s.number), false) AS connected, r.hidden_channels
        FROM wf_rows r JOIN wf_scan s ON s.session_id = r.session_id""",
    "occupancy_ranking": """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY bucket, distance, ap_count DESC, channel_number) AS place,
        channel_number, band, ap_count, bucket FROM (SELECT *, CASE WHEN bucket = 1 THEN abs(channel_number - mine) ELSE 0 END AS distance FROM (
        SELECT e.*, w.channel_number AS mine, CASE WHEN w.channel_number = e.channel_number THEN 0 WHEN ap_count <= 2 THEN 3 WHEN w.channel_band = band THEN 1 ELSE 2 END AS bucket
        FROM (SELECT n.session_id, n.channel_number, count(*) AS ap_count, arg_min(n.channel_band, pos) AS band FROM neighbors n JOIN lscan USING (session_id, scan_seq)
        GROUP BY 1, 2) e LEFT JOIN lwifi w ON w.session_id = e.session_id))""",
    "neighbor_table": f"""SELECT n.session_id, row_number() OVER (PARTITION BY n.session_id ORDER BY n.rssi_dbm DESC, pos) AS place, n.ssid, n.bssid, n.rssi_dbm,
        n.channel_number, {_quality(_rssi_good('n.rssi_dbm'))} AS quality, coalesce(n.bssid = w.bssid, false) AS is_current FROM neighbors n
        JOIN lscan USING (session_id, scan_seq) LEFT JOIN lwifi w ON w.session_id = n.session_id QUALIFY place <= 8""",
    "findings_ranking": f"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY peak_confidence DESC, fingerprint) AS place, fingerprint, peak_confidence,
        confidence, {_LABEL.format(x=_f32('confidence'))} AS label, {_dur(_ACTIVE_SECS)} AS active_for FROM active QUALIFY place <= 8""",
    "rf_summary": f"""SELECT e.session_id, e.channel_number, CASE WHEN e.channel_number IS NOT NULL THEN {_tier('channel_aps')} END AS pressure,
        CASE WHEN EXISTS (SELECT 1 FROM active a WHERE a.session_id = e.session_id AND fingerprint = 'rf_density_trend:rising') THEN 'density rising'
        WHEN EXISTS (SELECT 1 FROM active a WHERE a.session_id = e.session_id AND fingerprint = 'rf_density_trend:falling') THEN 'density falling'
        ELSE 'density stable' END AS trend FROM (SELECT * FROM asof3 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY at_us DESC, is_tick DESC, seq DESC) = 1) e""",
    "latest_health": "SELECT session_id, sensor, seq, at_us, state FROM health QUALIFY row_number() OVER (PARTITION BY session_id, sensor ORDER BY seq DESC) = 1",
}
QUERIES["ping_ingest"] = """SELECT session_id, seq, at_us, target, CAST(round(x * 1000000) AS BIGINT) AS rtt_nanos,
    {ms} AS rtt_ms, reachable, probe FROM (SELECT *, CASE WHEN reachable THEN rtt_ms ELSE 900e0 END AS x FROM gateway)""".format(
    ms=_ms("CAST(round(x * 1000000) AS BIGINT)")
)
QUERIES["session_roundtrip"] = QUERIES["session_summary"].rsplit(", CASE", 1)[0] + " FROM log GROUP BY 1"
QUERIES["stream_tally"] = QUERIES["running_tally"]
QUERIES["stream_findings"] = QUERIES["findings"]
QUERIES["stream_epochs"] = """SELECT session_id, seq, at_us, 'association' AS kind, lost, epoch, since_us, identity_key FROM assoc
    UNION ALL SELECT session_id, seq, at_us, 'counter', lost, epoch, min(at_us) OVER (PARTITION BY session_id, epoch), NULL FROM cnt"""
_RAW_CHANNEL = """CASE {pos} % 4 WHEN 0 THEN 'FiveGhz' WHEN 2 THEN 'TwoPointFourGhz' ELSE {band} END AS channel_band,
    CASE {pos} % 4 WHEN 0 THEN 'Mhz80' WHEN 1 THEN 'Mhz40' WHEN 2 THEN 'Mhz20' END AS channel_width"""
QUERIES["capture_text"] = """SELECT session_id, scan_seq, pos, CASE WHEN pos % 5 >= 2 THEN ssid END AS ssid,
    CASE WHEN pos % 6 <> 0 THEN bssid END AS bssid, rssi_dbm, -90 - pos % 10 AS noise_dbm, channel_number, {ch},
    ['Wpa3Transition', 'Wpa3', 'Wpa2', 'Wpa', 'Wep', 'Open', 'Unknown'][pos % 7 + 1] AS security,
    CASE WHEN pos % 5 >= 2 AND pos % 6 <> 0 THEN 'Direct' ELSE 'Inferred' END AS confidence FROM neighbors""".format(
    ch=_RAW_CHANNEL.format(pos="pos", band=_band("channel_number"))
)
QUERIES["capture_ingest"] = """SELECT session_id || '/' || seq AS capture_id, at_us, part, ssid, bssid, rssi_dbm, channel_number, {ch},
    CASE WHEN bssid IS NULL THEN 'Inferred' ELSE 'Direct' END AS confidence FROM (SELECT * EXCLUDE (channel_band), unnest(['link', 'neighbor']) AS part FROM wifi)""".format(
    ch=_RAW_CHANNEL.format(pos="seq", band=_band("channel_number"))
)
QUERIES["recent_feed"] = f"SELECT * FROM ({QUERIES['event_feed']}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 200"

# First moment all sources are covered, by checking every event against history.
QUERIES["coverage_time"] = f"""SELECT session_id, min(seq) AS seq, arg_min(at_us, seq) AS at_us FROM (
    SELECT l.session_id, l.seq, l.at_us, s.source, {_secs("arg_max(p.at_us, p.seq) FILTER (p.event_type <> 'SensorHealth') - arg_min(p.at_us, p.seq) FILTER (p.event_type <> 'SensorHealth')")} AS span,
    arg_max(p.health_state, p.seq) FILTER (p.event_type = 'SensorHealth') AS state FROM log l
    CROSS JOIN (SELECT unnest(['gateway', 'dns', 'iface', 'wifi']) AS source) s JOIN log p ON p.session_id = l.session_id AND p.source = s.source AND p.seq <= l.seq
    GROUP BY 1, 2, 3, 4) GROUP BY 1, seq, at_us HAVING count(*) FILTER (coalesce(state <> 'Operational', false) OR coalesce(span >= 30, false)) = 4"""
QUERIES["coverage_time"] = f"SELECT session_id, min(seq) AS seq, min(at_us) AS at_us FROM ({QUERIES['coverage_time']}) GROUP BY 1"


def build(body: str, fragments: dict[str, str] | None = None) -> str:
    """``body`` with every fragment it mentions, directly or not, in front."""
    fragments = fragments or FRAGMENTS
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", sql):
            if name in fragments and name not in needed and fragments[name] is not sql:
                visit(fragments[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = "WITH RECURSIVE " if "chain" in needed else "WITH "
    return head + ",\n".join(f"{n} AS ({fragments[n]})" for n in needed) + "\n" + body


# State at a playhead: the same fragments over an event table cut there.
_CUT = dict(FRAGMENTS)
_CUT["ev0"] = FRAGMENTS["ev"]
_CUT["ends0"] = "SELECT session_id, min(seq) AS a, max(seq) AS b FROM ev0 GROUP BY 1"
_CUT["ev"] = "SELECT e.* FROM ev0 e JOIN ends0 x ON x.session_id = e.session_id AND e.seq <= (a + b) // 2"
_STATE = """SELECT s.session_id, s.events, l.ssid, l.bssid, l.rssi_dbm, l.held_secs, l.delta, n.n_neighbors AS visible_aps, g.median_ms AS gateway_ms, g.loss_pct,
    d.median_ms AS dns_ms, d.fail_pct, c.rx_bytes, c.tx_bytes, c.total_errors, h.degraded_sensors
    FROM (SELECT session_id, count(*) AS events FROM log GROUP BY 1) s LEFT JOIN lc2 l USING (session_id)
    LEFT JOIN (SELECT session_id, arg_max(n_neighbors, seq) AS n_neighbors FROM scans GROUP BY 1) n USING (session_id)
    LEFT JOIN ({gw}) g USING (session_id) LEFT JOIN ({dns}) d USING (session_id) LEFT JOIN ({cnt}) c USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) FILTER (state <> 'Operational') AS degraded_sensors FROM ({hl}) GROUP BY 1) h USING (session_id)""".format(
    gw=QUERIES["latency_card"], dns=QUERIES["dns_card"], cnt=QUERIES["latest_counters"], hl=QUERIES["latest_health"]
)


def oracle_sql() -> dict[str, str]:
    out = {name: build(sql) for name, sql in QUERIES.items()}
    state = build(_STATE, _CUT)
    active = build(
        """SELECT session_id, count(*) AS active_findings FROM (SELECT f.* FROM find f JOIN ph USING (session_id) WHERE f.at_us <= playhead_us
        QUALIFY row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY f.at_us DESC, is_tick DESC, f.seq DESC) = 1) WHERE lifecycle <> 'Resolved' GROUP BY 1"""
    )
    out["state_as_of"] = f"SELECT s.*, a.active_findings FROM ({state}) s LEFT JOIN ({active}) a USING (session_id)"
    return out
