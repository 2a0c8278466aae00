"""Thresholds and spans, all overridable.

Spans are whole seconds.  ``second_us`` says how many microseconds of event
time one such second is, so that the same operators run over recordings on a
different time scale.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    second_us: int = 1_000_000

    # rolling windows
    latency_span: int = 30
    trend_span: int = 300
    throughput_span: int = 15
    signal_lookback: int = 90
    density_lookback: int = 120
    card_lookback: int = 60

    # bounded histories, in samples
    latency_history: int = 240
    signal_history: int = 90
    scan_history: int = 120
    throughput_history: int = 300
    feed_history: int = 200
    backlog: int = 4096

    # rules
    signal_trend_db: float = 5.0
    density_trend_aps: float = 3.0
    elevated_multiple: float = 2.0
    isolated_max: int = 1
    link_idle_bps: float = 50_000.0

    # evaluation and finding lifecycle
    tick: int = 2
    material_delta: float = 0.15
    cooldown: int = 15
    resolved_after: int = 20

    # landmarks
    median_probes: int = 30
    spike_multiple: float = 1.5
    spike_offset_ms: float = 5.0
    gateway_hold_probes: int = 3
    throughput_hold: int = 10
    wakeup_idle: int = 15

    # capture
    probe_timeout_ms: float = 900.0
    tally_every: int = 5
    coverage_window: int = 30
    expected_sources: tuple[str, ...] = ("gateway", "dns", "iface", "wifi")

    def us(self, seconds: float) -> int:
        """Microseconds of event time in ``seconds``."""
        return int(seconds * self.second_us)


DEFAULTS = Params()
