"""Findings of live sessions: windows, rules and lifecycle as one streaming query.

The windows (:mod:`.windows`) give timeline rows; the rules are the batch rules, Columns
over a row; the lifecycle keeps the episodes that are open.  Nothing is derived twice and
no history is read: the work of a micro-batch is that of its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import ladders as L
from ..operators import rules as R
from ..operators.timeline import INSTANT
from ..params import DEFAULTS, Params
from .windows import event_of, row_of, timeline_stream

_EPISODE = (
    "fingerprint string, kind string, first bigint, seen bigint, emitted bigint, shown float, peak float, "
    "numbers array<double>, words array<string>"
)
_FOUND = (
    "session_id string, at_us bigint, is_tick int, seq bigint, kind string, fingerprint string, confidence float, "
    "peak_confidence float, numbers array<double>, words array<string>, lifecycle string, first_seen_us bigint, last_seen_us bigint"
)


class Episodes:
    """Open episodes of one session, advanced one evaluation at a time."""

    def __init__(self, p: Params, held: list[tuple] = ()):
        self.late, self.cooldown, self.delta = p.us(p.resolved_after), p.us(p.cooldown), np.float32(p.material_delta)
        self.open = {e[0]: list(e) for e in held}

    def evaluate(self, instant: tuple, candidates: list) -> Iterator[tuple]:
        """Transitions at ``instant`` (at_us, is_tick, seq)."""
        at = instant[0]
        for c in candidates:
            level = np.float32(c.confidence)
            e = self.open.get(c.fingerprint)
            if e is None:
                told = "Active"
                e = self.open[c.fingerprint] = [c.fingerprint, c.kind, at, at, at, float(level), float(level), None, None]
            else:
                change = level - np.float32(e[5])
                e[3], e[6] = at, max(e[6], float(level))
                told = None
                if abs(change) >= self.delta and at - e[4] >= self.cooldown:
                    told = "Escalating" if change > 0 else "Recovering"
                    e[4], e[5] = at, float(level)
            e[1], e[7], e[8] = c.kind, list(c.numbers), list(c.words)
            if told:
                yield self._told(instant, e, float(level), told)
        seen = {c.fingerprint for c in candidates}
        for e in [e for f, e in self.open.items() if f not in seen and at - e[3] >= self.late]:
            del self.open[e[0]]
            yield self._told(instant, e, 0.0, "Resolved")

    @staticmethod
    def _told(instant: tuple, e: list, confidence: float, lifecycle: str) -> tuple:
        return (*instant, e[1], e[0], confidence, e[6], e[7], e[8], lifecycle, e[2], instant[0])


class LifecycleProcessor(StatefulProcessor):
    """Rows are evaluations: an instant with a candidate, or an instant alone.  Those of an
    initial state (``evaluations``, an array) open and close episodes and give nothing out."""

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("episodes", _EPISODE)

    def _told(self, rows: Iterable) -> Iterator[tuple]:
        episodes = Episodes(self.p, [tuple(r) for r in self.held.get()] if self.held.exists() else [])
        at: dict[tuple, list] = {}
        for r in rows:
            found = at.setdefault((r.at_us, r.is_tick, r.seq), [])
            if r.fingerprint is not None:
                found.append(r)
        for instant in sorted(at):
            yield from episodes.evaluate(instant, at[instant])
        if episodes.open:
            self.held.put([tuple(e) for e in episodes.open.values()])
        elif self.held.exists():
            self.held.clear()

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        for _ in self._told(map(event_of, initialState["evaluations"])):
            pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        out = row_of(_FOUND)
        for told in self._told(rows):
            yield out(key[0], *told)

    def close(self) -> None:
        pass


def evaluated(timeline: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Candidates of every evaluation; one row without where none fires."""
    return R.match(timeline, p, keep_instants=True)


def past_evaluations(past: DataFrame, timeline: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The initial state of the lifecycle: one row a session with the evaluations of its past
    events, up to the last of them.  ``timeline`` is the batch timeline of these events."""
    ends = past.groupBy("session_id").agg(F.max("at_us").alias("_last"))
    known = timeline.withColumn("session_id", F.col("session_id").cast("string")).join(ends, "session_id")
    # Ticks due with the last event or after it come with the stream.
    known = known.where((F.col("at_us") < F.col("_last")) | ((F.col("at_us") == F.col("_last")) & (F.col("is_tick") == 0)))
    rows = evaluated(known.drop("_last"), p)
    columns = [c for c in rows.columns if c != "session_id"]
    return rows.groupBy("session_id").agg(F.collect_list(F.struct(*columns)).alias("evaluations"))


def finding_stream(
    events: DataFrame,
    p: Params = DEFAULTS,
    quiet: float | None = None,
    past: DataFrame | None = None,
    past_timeline: DataFrame | None = None,
) -> DataFrame:
    """Finding transitions of streaming ``window_events`` (or ``envelope_events``), with text.

    ``past`` and ``past_timeline`` (batch) seed the windows and the open episodes, so that a
    query started late goes on as one that saw everything; ``quiet`` lets silent sessions
    resolve by the clock."""
    candidates = evaluated(timeline_stream(events, p, quiet, past), p)
    initial = None if past is None else past_evaluations(past, past_timeline, p).groupBy("session_id")
    found = candidates.groupBy("session_id").transformWithState(LifecycleProcessor(p), _FOUND, "append", "none", initial)
    found = found.select(
        "session_id",
        *INSTANT,
        "kind",
        "fingerprint",
        *[L.float32(L.clamp01(F.col(c))).alias(c) for c in ("confidence", "peak_confidence")],
        *("numbers", "words", "lifecycle", "first_seen_us", "last_seen_us"),
    )
    rendered = R.render(found, p)
    return rendered.withColumn("headline", L.lifecycle_headline(F.col("headline"), F.col("lifecycle")))
