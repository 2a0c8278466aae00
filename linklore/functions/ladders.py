"""Scalar ladders and small measures, all Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params

# Event variants and the category each belongs to.
CATEGORY = {
    "Wifi": "Wifi",
    "Scan": "Wifi",
    "GatewayLatency": "Gateway",
    "DnsLatency": "Dns",
    "InterfaceStateChanged": "Interface",
    "InterfaceCounters": "Interface",
    "RoamDetected": "Roam",
    "Finding": "Finding",
    "SensorHealth": "Health",
}
EVENT_TYPES = tuple(CATEGORY)

# Sensor states after which a sensor's link or counter history no
# longer describes the present.
WIFI_LOST = ("HardwareDisabled", "BackendUnavailable", "PermissionDenied")
IFACE_LOST = ("Stale", "BackendUnavailable", "HardwareDisabled")


def float32(x: Column) -> Column:
    return x.cast("float")


def f32(value: float) -> Column:
    return F.lit(value).cast("float")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def category(event_type: Column) -> Column:
    pairs = [F.lit(v) for pair in CATEGORY.items() for v in pair]
    return F.element_at(F.create_map(*pairs), event_type)


def whole_seconds(delta_us: Column, p: Params = DEFAULTS) -> Column:
    """Whole seconds of a difference, truncated toward zero."""
    return (delta_us / F.lit(p.second_us)).cast("bigint")


def active_duration(first_us: Column, last_us: Column, p: Params = DEFAULTS) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), whole_seconds(last_us - first_us, p))


def canonical_bssid(x: Column) -> Column:
    return F.lower(x)


def band_from_channel(number: Column) -> Column:
    return (
        F.when(number.between(1, 14), F.lit("TwoPointFourGhz"))
        .when(number.between(32, 177), F.lit("FiveGhz"))
        .otherwise(F.lit("Unknown"))
    )


def settled_band(band: Column, number: Column) -> Column:
    """The band, re-derived from the number where the source did not know it."""
    return F.when(band == "Unknown", band_from_channel(number)).otherwise(band)


def band_rank(band: Column) -> Column:
    return (
        F.when(band == "TwoPointFourGhz", 0)
        .when(band == "FiveGhz", 1)
        .when(band == "SixGhz", 2)
        .otherwise(3)
    )


def snr_db(rssi: Column, noise: Column) -> Column:
    return rssi - noise


def duration_ms(secs: Column, nanos: Column) -> Column:
    return (secs.cast("double") + nanos.cast("double") / F.lit(1e9)) * F.lit(1000.0)


def nanos_to_ms(nanos: Column) -> Column:
    """A nanosecond total, through the same seconds + nanos sum."""
    return duration_ms(F.floor(nanos / 1_000_000_000), nanos % 1_000_000_000)


def pressure_tier(count: Column) -> Column:
    return (
        F.when(count <= 2, "low")
        .when(count <= 5, "moderate")
        .when(count <= 8, "elevated")
        .otherwise("severe")
    )


def gateway_stance(
    reachable: Column, ms: Column, median: Column, p: Params = DEFAULTS
) -> Column:
    limit = F.coalesce(median, F.lit(0.0)) * p.spike_multiple + p.spike_offset_ms
    return (
        F.when(~reachable, "unreachable").when(ms > limit, "spiking").otherwise("stable")
    )


def dns_stance(answered: Column) -> Column:
    return F.when(answered, "answering").otherwise("failing")


def throughput_regime(rx_bps: Column, tx_bps: Column) -> Column:
    peak = F.greatest(rx_bps, tx_bps)
    return (
        F.when(peak < 50_000.0, "idle")
        .when(peak < 500_000.0, "trickle")
        .when(peak < 25_000_000.0, "sustained")
        .otherwise("bursting")
    )


def rssi_goodness(rssi: Column) -> Column:
    held = F.greatest(F.lit(-90), F.least(F.lit(-30), rssi))
    return float32((held + 90) / F.lit(60.0))


def rtt_goodness(ms: Column, good: float, bad: float) -> Column:
    slope = F.lit(1.0) - (ms - good) / F.lit(bad - good)
    return float32(F.when(ms <= good, 1.0).when(ms >= bad, 0.0).otherwise(slope))


def quality(goodness: Column) -> Column:
    return (
        F.when(goodness >= f32(0.66), "ok").when(goodness >= f32(0.33), "warn").otherwise("bad")
    )


def confidence_label(confidence: Column) -> Column:
    return (
        F.when(confidence >= f32(0.7), "bad")
        .when(confidence >= f32(0.4), "warn")
        .otherwise("info")
    )


def density_class(count: Column) -> Column:
    """Landmarks in a strip cell: none, one, few, many."""
    return (
        F.when(count == 0, "none").when(count == 1, "one").when(count <= 3, "few").otherwise("many")
    )


def upper_median(ordered: Column) -> Column:
    """Element ``n div 2`` (0-based) of a sorted array; null when empty."""
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.floor(n / 2).cast("int")))


def nearest_p95(ordered: Column) -> Column:
    n = F.size(ordered)
    at = F.least(F.floor(n * F.lit(0.95)).cast("int"), n - 1)
    return F.when(n > 0, F.get(ordered, at))


def lifecycle_headline(headline: Column, lifecycle: Column) -> Column:
    suffix = (
        F.when(lifecycle == "Escalating", " \u2014 worsening")
        .when(lifecycle == "Recovering", " \u2014 easing")
        .when(lifecycle == "Resolved", " \u2014 resolved")
        .otherwise("")
    )
    return F.concat(headline, suffix)
