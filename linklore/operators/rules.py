"""Rules: last-known state at an instant in, at most one candidate finding out.

A rule has two halves.  The *condition* half says where it fires and keeps the
few numbers and words its text needs.  The *text* half turns those into headline
and evidence.  Rules run at every instant but only transitions are published, so
text is rendered after the lifecycle, for published findings only.

All rules are evaluated in one pass over :func:`timeline.timeline`.  The registry
at the end is the extension point.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..functions.text import fixed, peak_rate
from ..params import DEFAULTS, Params
from .timeline import INSTANT
from .windows import link_idle


@dataclass(frozen=True)
class Match:
    """Condition half: evaluated on a timeline row."""

    fires: Column
    fingerprint: Column
    confidence: Column
    numbers: list[Column]
    words: list[Column]


@dataclass(frozen=True)
class Rule:
    """``needs`` names the timeline states the condition reads."""

    kind: str
    needs: tuple[str, ...]
    match: Callable[[Params], Match]
    headline: Callable[[Column, Column, Params], Column]
    evidence: Callable[[Column, Column, Params], list[Column]]


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _n(x: Column) -> Column:
    """A whole number kept among the numbers."""
    return x.cast("bigint").cast("string")


def _percent(ratio: Column) -> Column:
    return fixed(L.float32(L.float32(ratio) * L.f32(100.0)), 0)


# -- congestion on the connected channel -----------------------------------


def _congestion(p: Params) -> Match:
    n, number = F.col("rf.channel_aps"), F.col("rf.link.channel_number")
    tier = L.pressure_tier(n)
    return Match(
        number.isNotNull() & tier.isin("elevated", "severe"),
        _say("rf_congestion:ch", number.cast("string")),
        F.when(tier == "elevated", 0.55).otherwise(0.8),
        [number, n, F.coalesce("rf.heard.n_neighbors", F.lit(0))],
        [tier],
    )


def _congestion_headline(n: Column, w: Column, p: Params) -> Column:
    return _say(
        "Local RF congestion ", w[0], " on channel ", _n(n[0]),
        " (", _n(n[1]), " APs share the channel)",
    )


def _congestion_evidence(n: Column, w: Column, p: Params) -> list[Column]:
    return [
        _say("APs on connected channel (", _n(n[0]), "): ", _n(n[1])),
        _say("Total visible APs: ", _n(n[2])),
        _say("Local pressure tier: ", w[0]),
    ]


# -- unstable gateway ------------------------------------------------------


def _gateway(p: Params) -> Match:
    gw = F.col("gw")
    n, loss, median, p95 = gw["n"], gw["loss"], gw["median_ms"], gw["p95_ms"]
    rx, tx = F.col("tput.rx_bps"), F.col("tput.tx_bps")
    jitter = F.when(median > 0, p95 / median).otherwise(1.0)
    idle = link_idle(rx, tx, p.link_idle_bps)
    little_loss = loss < L.f32(0.05)
    calm = little_loss & (jitter < 4.0)
    waking = (gw["elevated"] <= p.isolated_max) & idle & little_loss
    return Match(
        (n >= 5) & median.isNotNull() & ~calm & ~waking,
        _say("gateway_instability:", gw["target"]),
        L.clamp(
            loss.cast("double") * 1.5 + F.least(jitter - 1.0, F.lit(5.0)) * 0.10, 0.0, 0.95
        ),
        [loss, median, p95, gw["elevated"], n, F.greatest(rx, tx)],
        [gw["target"], F.when(idle, "idle").otherwise("active")],
    )


def _gateway_headline(n: Column, w: Column, p: Params) -> Column:
    return _say(
        "Gateway ", w[0], " unstable: ", _percent(n[0]), "% loss, p95 ",
        fixed(n[2], 0), " ms vs median ", fixed(n[1], 0), " ms",
    )


def _gateway_evidence(n: Column, w: Column, p: Params) -> list[Column]:
    return [
        _say("Loss ratio: ", fixed(n[0], 2)),
        _say("Median RTT: ", fixed(n[1], 1), " ms"),
        _say("p95 RTT: ", fixed(n[2], 1), " ms"),
        _say(
            f"Elevated samples (>{p.elevated_multiple:.1f}\u00d7 median): ",
            _n(n[3]), "/", _n(n[4]),
        ),
        _say("Link recently ", w[1], " (rolling RX/TX peak ", peak_rate(n[5]), ")"),
    ]


# -- failing or slow name resolution ---------------------------------------


def _resolver(p: Params) -> Match:
    fail, n = F.col("dns.fail"), F.col("dns.n")
    median = F.coalesce("dns.median_ms", F.lit(0.0))
    healthy = (
        (F.coalesce(F.col("gw.loss"), L.f32(0.0)) < L.f32(0.10))
        & (F.coalesce("gw.median_ms", F.lit(0.0)) < 80.0)
        & (F.coalesce("gw.n", F.lit(0)) >= 3)
    )
    share = fail.cast("double")
    return Match(
        (n >= 4) & ((fail >= L.f32(0.25)) | (median >= 150.0)),
        F.lit("dns_pathology"),
        F.when(healthy, L.clamp(share * 1.5 + median / 1000.0, 0.3, 0.9)).otherwise(
            L.clamp(share + median / 2000.0, 0.15, 0.55)
        ),
        [fail, median, n],
        [healthy.cast("string")],
    )


def _resolver_headline(n: Column, w: Column, p: Params) -> Column:
    return _say("DNS pathology: ", _percent(n[0]), "% failures, median ", fixed(n[1], 0), " ms")


def _resolver_evidence(n: Column, w: Column, p: Params) -> list[Column]:
    return [
        _say("DNS failure ratio: ", fixed(n[0], 2)),
        _say("DNS median RTT: ", fixed(n[1], 1), " ms"),
        _say("Gateway looks healthy: ", w[0]),
        _say("DNS samples in window: ", _n(n[2])),
    ]


# -- holding on to a weak access point -------------------------------------


def _sticky(p: Params) -> Match:
    link, other = F.col("rf.link"), F.col("rf.alternative")
    rssi = link["rssi_dbm"]
    gain = other["rssi_dbm"] - rssi
    return Match(
        (rssi <= -70) & link["ssid"].isNotNull() & link["bssid"].isNotNull() & (gain >= 10),
        _say("sticky_client:", link["ssid"]),
        F.when(gain >= 20, 0.8).when(gain >= 15, 0.6).otherwise(0.4),
        [rssi, other["rssi_dbm"], gain],
        [other["bssid"]],
    )


def _sticky_headline(n: Column, w: Column, p: Params) -> Column:
    return _say(
        "Sticky client suspected: holding ", _n(n[0]), " dBm while ", w[0], " is ", _n(n[1]), " dBm"
    )


def _sticky_evidence(n: Column, w: Column, p: Params) -> list[Column]:
    return [
        _say("Current AP RSSI: ", _n(n[0]), " dBm"),
        _say("Strongest same-SSID neighbor RSSI: ", _n(n[1]), " dBm"),
        _say("Delta: ", _n(n[2]), " dB"),
    ]


# -- trends ----------------------------------------------------------------


def _signal(p: Params) -> Match:
    delta, sig = F.col("rssi_delta"), F.col("sig")
    way = F.when(delta < 0, "degrading").otherwise("recovering")
    held = L.active_duration(sig["since_us"], F.col("at_us"), p)
    return Match(
        F.abs(delta) >= p.signal_trend_db,
        _say("signal_trend:", sig["identity_key"], ":", way),
        L.clamp(F.abs(delta) / 15.0, 0.3, 0.85),
        [delta, sig["samples"], held],
        [F.when(delta < 0, "deteriorating").otherwise("recovering")],
    )


def _signal_headline(n: Column, w: Column, p: Params) -> Column:
    return _say(
        "Signal quality ", w[0], " (", fixed(n[0], 0, plus=True),
        f" dB over {p.signal_lookback}s)",
    )


def _signal_evidence(n: Column, w: Column, p: Params) -> list[Column]:
    return [
        _say(f"RSSI \u0394 over {p.signal_lookback}s: ", fixed(n[0], 1, plus=True), " dB"),
        _say("Samples in window: ", _n(n[1])),
        _say("Connected for: ", _n(n[2]), "s"),
    ]


def _density(p: Params) -> Match:
    delta, env = F.col("density_delta"), F.col("env")
    way = F.when(delta > 0, "rising").otherwise("falling")
    return Match(
        F.abs(delta) >= p.density_trend_aps,
        _say("rf_density_trend:", way),
        L.clamp(F.abs(delta) / 10.0, 0.3, 0.8),
        [delta, env["ap_count"], env["samples"]],
        [way],
    )


def _density_headline(n: Column, w: Column, p: Params) -> Column:
    return _say(
        "Ambient RF density ", w[0], " (", fixed(n[0], 0, plus=True),
        f" APs over {p.density_lookback}s, now ", _n(n[1]), ")",
    )


def _density_evidence(n: Column, w: Column, p: Params) -> list[Column]:
    return [
        _say("Mean AP-count \u0394: ", fixed(n[0], 1, plus=True)),
        _say("Current AP count: ", _n(n[1])),
        _say("Scan samples in window: ", _n(n[2])),
    ]


RULES: dict[str, Rule] = {
    "rf_congestion": Rule("RfCongestion", ("rf",), _congestion, _congestion_headline, _congestion_evidence),
    "gateway_instability": Rule(
        "GatewayInstability", ("gw", "tput"), _gateway, _gateway_headline, _gateway_evidence
    ),
    "dns_pathology": Rule("DnsPathology", ("dns", "gw"), _resolver, _resolver_headline, _resolver_evidence),
    "sticky_client": Rule("StickyClient", ("rf",), _sticky, _sticky_headline, _sticky_evidence),
    "signal_trend": Rule("SignalTrend", ("sig",), _signal, _signal_headline, _signal_evidence),
    "rf_density_trend": Rule("RfDensityTrend", ("env",), _density, _density_headline, _density_evidence),
}


def needed(rules: dict[str, Rule] | None = None) -> set[str]:
    """Timeline states the given rules (default: all) read."""
    return {state for rule in (rules or RULES).values() for state in rule.needs}


def match(
    timeline: DataFrame,
    p: Params = DEFAULTS,
    rules: dict[str, Rule] | None = None,
    keep_instants: bool = False,
) -> DataFrame:
    """Candidates of the given rules (default: all), text not rendered.  With
    ``keep_instants`` an instant at which none fires is a row without candidate."""
    found = []
    for rule in (rules or RULES).values():
        m = rule.match(p)
        candidate = F.struct(
            F.lit(rule.kind).alias("kind"),
            m.fingerprint.alias("fingerprint"),
            L.float32(m.confidence).alias("confidence"),
            F.array(*[x.cast("double") for x in m.numbers]).alias("numbers"),
            F.array(*m.words).alias("words"),
        )
        found.append(F.when(m.fires, candidate))
    each = F.explode_outer if keep_instants else F.explode
    return timeline.select(
        "session_id", *INSTANT, each(F.array_compact(F.array(*found))).alias("c")
    ).select("session_id", *INSTANT, "c.*")


def render(
    candidates: DataFrame, p: Params = DEFAULTS, rules: dict[str, Rule] | None = None
) -> DataFrame:
    """Replace ``numbers`` and ``words`` by ``headline`` and ``evidence``."""
    n, w = F.col("numbers"), F.col("words")
    headline = evidence = F
    for rule in (rules or RULES).values():
        mine = F.col("kind") == rule.kind
        headline = headline.when(mine, rule.headline(n, w, p))
        evidence = evidence.when(mine, F.array(*rule.evidence(n, w, p)))
    return candidates.select(
        *[c for c in candidates.columns if c not in ("numbers", "words")],
        headline.alias("headline"),
        evidence.alias("evidence"),
    )


def evaluate(
    timeline: DataFrame, p: Params = DEFAULTS, rules: dict[str, Rule] | None = None
) -> DataFrame:
    """Candidates with their text."""
    return render(match(timeline, p, rules), p, rules)
