"""The six windows of a session as state of a streaming query.

A session's windows are kept between micro-batches and advance one event at a time:
latency frames with their values in order (a value is put in its place on arrival and
taken out on eviction), signal and density series with running sums, the throughput
epoch, the link and the latest scan.  Each event that evaluates, and each tick of the
session's timer, gives the row that :func:`operators.timeline.timeline` gives, so the
rules run on it unchanged.  Only windows that changed are written back.

Rows of one micro-batch are taken in event order; across batches arrival order is the
truth.  A heartbeat row (``event_type`` ``Heartbeat``) moves a session's timer without an
event, so a silent session goes on being evaluated; see :func:`heartbeats`.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import ladders as L
from ..operators.timeline import EVALUATED, INSTANT
from ..params import DEFAULTS, Params
from ..sources.recording import Recording

HEARTBEAT = "Heartbeat"
_AP = "struct<pos:bigint,bssid:string,ssid:string,rssi_dbm:int,channel_number:int>"
_AP_FIELDS = ("pos", "bssid", "ssid", "rssi_dbm", "channel_number")
#: What the windows read of an event, whatever its variant.
_READ = {
    "event_type": "string", "target": "string", "ok": "boolean", "rtt_ms": "double",
    "ssid": "string", "bssid": "string", "rssi_dbm": "int", "channel_number": "int", "channel_band": "string",
    "n_neighbors": "bigint", "neighbors": f"array<{_AP}>",
    "interface": "string", "rx_bytes": "bigint", "tx_bytes": "bigint", "sensor": "string", "state": "string",
}


# -- input rows ------------------------------------------------------------


def _row(df: DataFrame, variant: str, **given: Column | str) -> DataFrame:
    given = {"event_type": F.lit(variant)} | given

    def value(name: str, kind: str) -> Column:
        col = given.get(name, F.lit(None))
        return (F.col(col) if isinstance(col, str) else col).cast(kind).alias(name)

    return df.select(F.col("session_id").cast("string").alias("session_id"), "seq", "at_us", *[value(n, k) for n, k in _READ.items()])


def window_events(rec: Recording, scans: DataFrame | None = None) -> DataFrame:
    """Every event of a recording as one kind of row.  ``scans`` has the scans with an array
    ``neighbors``; without it they are gathered here, which a stream cannot do."""
    if scans is None:
        ap = F.struct("pos", "bssid", "ssid", "rssi_dbm", "channel_number")
        heard = rec.neighbors.groupBy("session_id", F.col("scan_seq").alias("seq")).agg(F.collect_list(ap).alias("neighbors"))
        scans = rec.scans.join(heard, ["session_id", "seq"], "left")
    wifi = {n: n for n in ("ssid", "bssid", "rssi_dbm", "channel_number", "channel_band")}
    parts = [
        _row(rec.gateway, "GatewayLatency", target="target", ok="reachable", rtt_ms="rtt_ms"),
        _row(rec.dns, "DnsLatency", ok="answered", rtt_ms="rtt_ms"),
        _row(rec.wifi, "Wifi", **wifi),
        _row(scans, "Scan", n_neighbors="n_neighbors", neighbors="neighbors"),
        _row(rec.counters, "InterfaceCounters", interface="interface", rx_bytes="rx_bytes", tx_bytes="tx_bytes"),
        _row(rec.health, "SensorHealth", sensor="sensor", state="state"),
    ]
    # Other variants change no window, but a session's timer starts with its first event.
    rest = rec.log().where(~F.col("event_type").isin(*EVALUATED, "InterfaceCounters", "SensorHealth"))
    parts.append(_row(rest, "Other", event_type="event_type"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def envelope_events(envelopes: DataFrame) -> DataFrame:
    """The same rows from envelopes (``session_id, seq, at_us, event_type, event``), also streaming."""
    e = F.col("event")
    is_ = {v: F.col("event_type") == v for v in ("GatewayLatency", "DnsLatency", "Wifi", "Scan", "SensorHealth")}
    latency = is_["GatewayLatency"] | is_["DnsLatency"]

    def ap(x: Column, i: Column) -> Column:
        fields = [i.cast("bigint").alias("pos"), L.canonical_bssid(x["bssid"]).alias("bssid"), x["ssid"].alias("ssid")]
        return F.struct(*fields, x["rssi_dbm"].cast("int").alias("rssi_dbm"), x["channel"]["number"].cast("int").alias("channel_number"))

    values = {
        "event_type": F.col("event_type"),
        "target": F.when(is_["GatewayLatency"], e["target"]),
        "ok": F.when(is_["GatewayLatency"], e["reachable"]).when(is_["DnsLatency"], e["answered"]),
        "rtt_ms": F.when(latency, L.duration_ms(e["rtt"]["secs"], e["rtt"]["nanos"])),
        "bssid": F.when(is_["Wifi"], L.canonical_bssid(e["bssid"])),
        **{n: F.when(is_["Wifi"], e[n]) for n in ("ssid", "rssi_dbm")},
        **{f"channel_{n}": F.when(is_["Wifi"], e["channel"][n]) for n in ("number", "band")},
        "n_neighbors": F.when(is_["Scan"], F.size(e["neighbors"])),
        "neighbors": F.when(is_["Scan"], F.transform(e["neighbors"], ap)),
        "interface": F.when(F.col("event_type") == "InterfaceCounters", e["interface"]),
        "rx_bytes": e["rx_bytes_total"],
        "tx_bytes": e["tx_bytes_total"],
        **{n: F.when(is_["SensorHealth"], e[n]) for n in ("sensor", "state")},
    }
    cols = [values[n].cast(k).alias(n) for n, k in _READ.items()]
    return envelopes.select(F.col("session_id").cast("string").alias("session_id"), "seq", "at_us", *cols)


def heartbeats(events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One heartbeat a session, late enough that every finding last seen at its final event
    resolves.  Aggregates, so it is for a finished set of rows; a live source of heartbeats is
    any stream of (session_id, at_us) put through :func:`as_heartbeats`."""
    step = p.us(p.tick)
    ends = events.groupBy("session_id").agg(F.min("at_us").alias("first"), F.max("at_us").alias("last"))
    count = F.floor((F.col("last") - F.col("first") + p.us(p.resolved_after)) / step) + 2
    return as_heartbeats(ends.select("session_id", (F.col("first") + (count - 1) * step).alias("at_us")))


def as_heartbeats(beats: DataFrame) -> DataFrame:
    return _row(beats.withColumn("seq", F.lit(-1).cast("bigint")), HEARTBEAT)


def write_feed(events: DataFrame, path: str, slices: int) -> None:
    """Write events as files in slices of time, for a stream that reads files as they came:
    a session is in one file of a slice, so its rows arrive in order."""
    low, high = events.agg(F.min("at_us"), F.max("at_us")).first()
    if low is None:
        events.write.mode("append").parquet(path)
        return
    for i in range(slices):
        first, end = (low + (high + 1 - low) * k // slices for k in (i, i + 1))
        part = events.where((F.col("at_us") >= first) & (F.col("at_us") < end))
        part.repartition("session_id").write.mode("append").parquet(path)


# -- windows ---------------------------------------------------------------


@dataclass
class Latency:
    """Rows no older than ``span`` at the last one, and their successful times in order."""

    span: int
    rows: deque = field(default_factory=deque)
    ordered: list[float] = field(default_factory=list)
    bad: int = 0

    def add(self, at: int, ok: bool | None, ms: float | None) -> None:
        self._take(at, ok, ms)
        while self.rows[0][0] < at - self.span:
            _, ok, ms = self.rows.popleft()
            self.bad -= ok is False
            if ok and ms is not None:
                del self.ordered[bisect_left(self.ordered, ms)]

    def _take(self, at: int, ok: bool | None, ms: float | None) -> None:
        self.rows.append((at, ok, ms))
        self.bad += ok is False
        if ok and ms is not None:
            insort(self.ordered, ms)

    def load(self, rows: Iterable[tuple]) -> None:
        for row in rows:
            self._take(*row)

    def share_bad(self) -> float:
        return float(np.float32(self.bad / len(self.rows)))

    def at_rank(self, rank: int) -> float | None:
        return self.ordered[min(rank, len(self.ordered) - 1)] if self.ordered else None

    def median(self) -> float | None:
        return self.at_rank(len(self.ordered) // 2)

    def p95(self) -> float | None:
        return self.at_rank(int(len(self.ordered) * 0.95))

    def above(self, limit: float | None) -> int:
        """Values greater than ``limit``."""
        if limit is None:
            return 0
        lo, hi = 0, len(self.ordered)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.ordered[mid] <= limit else (lo, mid)
        return len(self.ordered) - lo


@dataclass
class Series:
    """Values with running sums; what is older than ``span`` is given up now and then."""

    span: int
    at: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=lambda: [0])  # sums of the values before each, and of all

    def add(self, at: int, value: int) -> None:
        self.at.append(at)
        self.value.append(value)
        self.before.append(self.before[-1] + value)
        stale = bisect_left(self.at, at - self.span)
        if 2 * stale > len(self.at):
            del self.at[:stale], self.value[:stale], self.before[:stale]

    def load(self, rows: Iterable[tuple]) -> None:
        for at, value in rows:
            self.at.append(at)
            self.value.append(value)
            self.before.append(self.before[-1] + value)

    def count(self, at: int) -> int:
        """Values no older than the span at ``at``."""
        return len(self.at) - bisect_left(self.at, at - self.span)

    def half_delta(self, at: int, lookback: int, half: int) -> float | None:
        """Mean of the recent half of a lookback minus that of the half before."""
        low, mid, top = bisect_left(self.at, at - lookback), bisect_left(self.at, at - half), len(self.at)
        if top - mid < 2 or mid - low < 2:
            return None
        return (self.before[top] - self.before[mid]) / (top - mid) - (self.before[mid] - self.before[low]) / (mid - low)


_SCALARS = (
    "first last next_tick associated epoch identity since samples sample rx_bps tx_bps metered lost_iface link heard rf gw dns env"
).split()


class SessionWindows:
    """Windows of one session: :meth:`advance` takes an event and gives timeline rows."""

    def __init__(self, p: Params = DEFAULTS):
        self.p, self.step = p, p.us(p.tick)
        span = p.us(p.latency_span)
        self.gateway, self.resolver = Latency(span), Latency(span)
        self.signal, self.density = Series(p.us(p.trend_span)), Series(p.us(p.trend_span))
        self.rates: deque = deque()  # counter rows of the epoch no older than the throughput span
        self.aps: list[tuple] = []
        self.first = self.last = self.next_tick = None  # first and last event, number of the next tick
        self.associated = False  # the last Wi-Fi row was an observation, not a loss
        self.epoch, self.identity, self.since, self.samples = 0, None, None, 0
        self.sample = None  # last counter row
        self.lost_iface = self.metered = False
        self.rx_bps = self.tx_bps = None
        self.link = self.heard = self.rf = self.gw = self.dns = self.env = None
        self.changed: set[str] = set()

    # -- state

    def saved(self) -> str:
        return json.dumps({n: getattr(self, n) for n in _SCALARS})

    def load(self, scalars: str, lists: dict[str, Iterable[tuple]]) -> None:
        for name, value in json.loads(scalars).items():
            setattr(self, name, value)
        self.gateway.load(lists["gateway"])
        self.resolver.load(lists["resolver"])
        self.signal.load(lists["signal"])
        self.density.load(lists["density"])
        self.rates.extend(lists["rates"])
        self._hear(list(lists["aps"]))

    def lists(self) -> dict[str, list[tuple]]:
        return {
            "gateway": list(self.gateway.rows), "resolver": list(self.resolver.rows),
            "signal": list(zip(self.signal.at, self.signal.value)), "density": list(zip(self.density.at, self.density.value)),
            "rates": list(self.rates), "aps": self.aps,
        }

    # -- events

    def advance(self, e) -> Iterator[tuple]:
        """Timeline rows up to and including this event."""
        if self.first is None:
            self.first, self.next_tick = e.at_us, 0
        if e.event_type == HEARTBEAT:
            yield from self.ticks(e.at_us + 1)
            return
        yield from self.ticks(e.at_us)
        self.last = e.at_us if self.last is None else max(self.last, e.at_us)
        take = getattr(self, f"_on_{e.event_type}", None)
        if take:
            take(e)
        if e.event_type in EVALUATED:
            yield self._state(e.at_us, 0, e.seq)

    def ticks(self, before: int) -> Iterator[tuple]:
        """Timeline rows of the ticks that are due before this time."""
        while (at := self.first + self.next_tick * self.step) < before:
            yield self._state(at, 1, self.next_tick)
            self.next_tick += 1

    def settled_at(self) -> int:
        """When everything that the last event left open is resolved."""
        return self.last + self.p.us(self.p.resolved_after) + 2 * self.step

    def _on_GatewayLatency(self, e) -> None:
        w = self.gateway
        w.add(e.at_us, e.ok, e.rtt_ms)
        self.changed.add("gateway")
        median = w.median()
        above = w.above(None if median is None else median * self.p.elevated_multiple)
        self.gw = [len(w.rows), w.share_bad(), median, w.p95(), above, e.target]

    def _on_DnsLatency(self, e) -> None:
        self.resolver.add(e.at_us, e.ok, e.rtt_ms)
        self.changed.add("resolver")
        self.dns = [len(self.resolver.rows), self.resolver.share_bad(), self.resolver.median()]

    def _on_Wifi(self, e) -> None:
        if not (self.associated and self.link[:2] == [e.ssid, e.bssid]):
            self.epoch, self.since, self.samples = self.epoch + 1, e.at_us, 0
            self.signal = Series(self.signal.span)
            self.changed.add("signal")
        self.associated = True
        self.identity = next((x for x in (e.bssid, e.ssid) if x is not None), "current")
        if e.rssi_dbm is not None:
            self.signal.add(e.at_us, e.rssi_dbm)
            self.samples = self.signal.count(e.at_us)
            self.changed.add("signal")
        self.link = [e.ssid, e.bssid, e.rssi_dbm, e.channel_number, e.channel_band]
        self._look_around()

    def _on_Scan(self, e) -> None:
        if e.n_neighbors is not None:
            self.density.add(e.at_us, e.n_neighbors)
        self.env = [e.n_neighbors, self.density.count(e.at_us)]
        self.heard = [e.seq, e.n_neighbors]
        self._hear([tuple(ap[name] for name in _AP_FIELDS) for ap in e.neighbors or ()])
        self.changed |= {"density", "aps"}
        self._look_around()

    def _on_InterfaceCounters(self, e) -> None:
        now, last = [e.at_us, e.interface, e.rx_bytes, e.tx_bytes], self.sample
        known = last is not None and not self.lost_iface and None not in (*now, *last)
        if not (known and last[1] == now[1] and now[2] >= last[2] and now[3] >= last[3]):
            self.rates.clear()
            last = None
        while self.rates and self.rates[0][0] < e.at_us - self.p.us(self.p.throughput_span):
            self.rates.popleft()
        first = self.rates[0] if self.rates else last and (last[0], *last[2:])
        self.rates.append((e.at_us, e.rx_bytes, e.tx_bytes))
        self.sample, self.lost_iface, self.metered = now, False, True
        secs = (e.at_us - first[0]) / float(self.p.second_us) if first else 0.0
        rate = lambda i: (self.rates[-1][i] - first[i]) / secs * 8.0 if secs >= 1.0 else None
        self.rx_bps, self.tx_bps = rate(1), rate(2)
        self.changed.add("rates")

    def _on_SensorHealth(self, e) -> None:
        if e.sensor == "wifi" and e.state in L.WIFI_LOST:
            self.epoch, self.associated, self.since, self.identity = self.epoch + 1, False, None, None
        if e.sensor == "iface" and e.state in L.IFACE_LOST:
            self.lost_iface, self.metered, self.rx_bps, self.tx_bps = True, True, None, None

    # -- link and scan

    def _hear(self, aps: list[tuple]) -> None:
        """Count the scan's access points by channel, and find the two best of each name."""
        self.aps, self.on_channel, self.strongest = aps, {}, {}
        for pos, bssid, ssid, rssi, channel in sorted(aps, key=lambda ap: (-(ap[3] or 0), ap[0])):
            if channel is not None:
                self.on_channel[channel] = self.on_channel.get(channel, 0) + 1
            if None not in (bssid, ssid, rssi):
                best = self.strongest.setdefault(ssid, [])
                if len(best) < 2 and bssid not in [b for b, _ in best]:
                    best.append((bssid, rssi))

    def _look_around(self) -> None:
        link = self.link or [None] * 5
        others = [ap for ap in self.strongest.get(link[0], []) if ap[0] != link[1]] if self.aps else []
        other = others[0] if others and link[1] is not None else (None, None)
        self.rf = [(self.on_channel.get(link[3], 0) if self.aps else 0), *other]

    # -- rows

    def _state(self, at: int, is_tick: int, seq: int) -> tuple:
        p = self.p
        half = lambda lookback: (p.us(lookback) // p.second_us // 2) * p.second_us
        rssi = density = None
        if self.associated:
            rssi = self.signal.half_delta(at, p.us(p.signal_lookback), half(p.signal_lookback))
        if self.env:
            density = self.density.half_delta(at, p.us(p.density_lookback), half(p.density_lookback))
        held = [self.epoch, self.identity, self.since, self.samples] if self.associated else [None] * 4
        return (
            at, is_tick, seq, *(self.gw or [None] * 6), *(self.dns or [None] * 3),
            self.link and _LINK_ROW(*self.link), self.heard and _HEARD_ROW(*self.heard), *(self.rf or [None] * 3),
            self.epoch > 0, *held, *(self.env or [None] * 2), self.metered, self.rx_bps, self.tx_bps, rssi, density,
        )


# -- the streaming operator ------------------------------------------------

_LISTS = {
    "gateway": "at bigint, ok boolean, ms double",
    "resolver": "at bigint, ok boolean, ms double",
    "signal": "at bigint, value bigint",
    "density": "at bigint, value bigint",
    "rates": "at bigint, rx bigint, tx bigint",
    "aps": "pos bigint, bssid string, ssid string, rssi_dbm int, channel_number int",
}
_LINK = "struct<ssid:string,bssid:string,rssi_dbm:int,channel_number:int,channel_band:string>"
_OUT = (
    "session_id string, at_us bigint, is_tick int, seq bigint, "
    "gw_n bigint, gw_loss float, gw_median_ms double, gw_p95_ms double, gw_elevated bigint, gw_target string, "
    f"dns_n bigint, dns_fail float, dns_median_ms double, link {_LINK}, heard struct<scan_seq:bigint,n_neighbors:bigint>, "
    "channel_aps bigint, other_bssid string, other_rssi int, linked boolean, epoch bigint, identity_key string, since_us bigint, "
    "samples bigint, ap_count bigint, env_samples bigint, metered boolean, rx_bps double, tx_bps double, "
    "rssi_delta double, density_delta double"
)
_LINK_ROW, _HEARD_ROW = Row("ssid", "bssid", "rssi_dbm", "channel_number", "channel_band"), Row("scan_seq", "n_neighbors")


def row_of(ddl: str) -> Row:
    """A maker of rows with the columns of a schema."""
    return Row(*[column.split()[0] for column in re.split(r", (?![^<]*>)", ddl)])


class WindowProcessor(StatefulProcessor):
    """Keeps :class:`SessionWindows` of a session between micro-batches.

    With ``quiet`` a session that has been silent for so many seconds of wall-clock time
    goes on by itself: its timer moves with the clock from then until everything open is
    resolved.  Rows of an initial state (``events``, an array) fill the windows and give
    nothing out."""

    def __init__(self, p: Params, quiet: float | None = None):
        self.p, self.quiet = p, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", "saved string")
        self.held = {name: handle.getListState(name, schema) for name, schema in _LISTS.items()}
        if self.quiet is not None:
            self.arrived = handle.getValueState("arrived", "clock_ms bigint")

    def _load(self) -> SessionWindows:
        windows = SessionWindows(self.p)
        if self.scalars.exists():
            lists = {name: [tuple(r) for r in state.get()] if state.exists() else [] for name, state in self.held.items()}
            windows.load(self.scalars.get()[0], lists)
        return windows

    def _save(self, windows: SessionWindows) -> None:
        self.scalars.update((windows.saved(),))
        now = windows.lists()
        for name in windows.changed:
            if now[name]:
                self.held[name].put(now[name])
            else:
                self.held[name].clear()

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        windows = self._load()
        for event in sorted(map(event_of, initialState["events"]), key=_place):
            for _ in windows.advance(event):
                pass
        self._save(windows)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        windows, out = self._load(), row_of(_OUT)
        for event in sorted(rows, key=_place):
            for state in windows.advance(event):
                yield out(key[0], *state)
        self._save(windows)
        if self.quiet is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            now = timerValues.getCurrentProcessingTimeInMs()
            self.arrived.update((now,))
            self.handle.registerTimer(now + round(self.quiet * 1000))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        windows, out = self._load(), row_of(_OUT)
        if windows.last is None:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        clock = windows.last + (now - self.arrived.get()[0]) * 1000
        for state in windows.ticks(min(clock, windows.settled_at())):
            yield out(key[0], *state)
        self._save(windows)
        if clock < windows.settled_at():
            self.handle.registerTimer(now + max(1, self.p.us(self.p.tick) // 1000))

    def close(self) -> None:
        pass


def _place(event) -> tuple:
    return event.at_us, event.event_type == HEARTBEAT, event.seq


def event_of(fields) -> Row:
    """An event of an array, whichever way its struct arrives."""
    return fields if isinstance(fields, Row) else Row(**fields)


def seed(events: DataFrame) -> DataFrame:
    """The initial state of :func:`timeline_stream`: one row a session with its past events (a
    backlog: :func:`operators.projections.backlog` bounds it)."""
    columns = [c for c in events.columns if c != "session_id"]
    return events.groupBy("session_id").agg(F.collect_list(F.struct(*columns)).alias("events"))


def timeline_stream(
    events: DataFrame, p: Params = DEFAULTS, quiet: float | None = None, past: DataFrame | None = None
) -> DataFrame:
    """The timeline (:func:`operators.timeline.timeline`) of streaming ``window_events``, after
    the ``past`` ones (batch rows, see :func:`seed`).  ``quiet``: see :class:`WindowProcessor`."""
    initial = None if past is None else seed(past).groupBy("session_id")
    mode = "none" if quiet is None else "processingTime"
    flat = events.groupBy("session_id").transformWithState(WindowProcessor(p, quiet), _OUT, "append", mode, initial)

    def when(known: str, *fields: Column) -> Column:
        return F.when(F.col(known).isNotNull(), F.struct(*fields))

    def prefixed(name: str, *fields: str) -> list[Column]:
        return [F.col(f"{name}_{f}").alias(f) for f in fields]

    other = when("other_bssid", F.col("other_bssid").alias("bssid"), F.col("other_rssi").alias("rssi_dbm"))
    return flat.select(
        "session_id",
        *INSTANT,
        when("gw_n", *prefixed("gw", "n", "loss", "median_ms", "p95_ms", "elevated", "target")).alias("gw"),
        when("dns_n", *prefixed("dns", "n", "fail", "median_ms")).alias("dns"),
        when("channel_aps", F.col("link"), F.col("heard"), F.col("channel_aps"), other.alias("alternative")).alias("rf"),
        F.when(F.col("linked"), F.struct("epoch", "identity_key", "since_us", "samples")).alias("sig"),
        when("env_samples", F.col("ap_count"), F.col("env_samples").alias("samples")).alias("env"),
        F.when(F.col("metered"), F.struct("rx_bps", "tx_bps")).alias("tput"),
        "rssi_delta",
        "density_delta",
    )
