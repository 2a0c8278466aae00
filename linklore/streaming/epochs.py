"""Association and counter epochs of live sessions.

An epoch is a session window that is keyed by change, not by a gap in time: it ends with
another identity, a counter that fell, or the loss of its sensor.  The state of a session
is the last row of either kind, so it has a fixed size however long the session is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import ladders as L
from .windows import row_of

_OUT = (
    "session_id string, seq bigint, at_us bigint, kind string, lost boolean, epoch bigint, since_us bigint, "
    "identity_key string"
)
ASSOCIATION, COUNTER = "association", "counter"


class Epochs:
    """Epochs of one session; ``state`` is all that is kept."""

    def __init__(self, state: dict | None = None):
        fresh = {"epoch": 0, "since": None, "row": None}
        self.state = state or {ASSOCIATION: dict(fresh), COUNTER: dict(fresh)}

    def take(self, e) -> tuple | None:
        """(kind, lost, epoch, since_us, identity_key) of a row that belongs to an epoch."""
        if e.event_type == "Wifi":
            return self._next(ASSOCIATION, e.at_us, [e.ssid, e.bssid], lambda a, b: a == b)
        if e.event_type == "InterfaceCounters":
            return self._next(COUNTER, e.at_us, [e.interface, e.rx_bytes, e.tx_bytes], self._goes_on)
        if e.event_type == "SensorHealth" and e.sensor == "wifi" and e.state in L.WIFI_LOST:
            return self._next(ASSOCIATION, e.at_us, None, None)
        if e.event_type == "SensorHealth" and e.sensor == "iface" and e.state in L.IFACE_LOST:
            return self._next(COUNTER, e.at_us, None, None)
        return None

    @staticmethod
    def _goes_on(last: list, now: list) -> bool:
        return None not in (*last, *now) and last[0] == now[0] and now[1] >= last[1] and now[2] >= last[2]

    def _next(self, kind: str, at: int, row: list | None, same) -> tuple:
        held = self.state[kind]
        if row is None or held["row"] is None or not same(held["row"], row):
            held["epoch"], held["since"] = held["epoch"] + 1, at
        held["row"] = row
        names = (row[1], row[0]) if row and kind == ASSOCIATION else ()
        identity = next((n for n in names if n is not None), "current") if kind == ASSOCIATION else None
        return kind, row is None, held["epoch"], held["since"], identity


class EpochProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("epochs", "saved string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        epochs = Epochs(json.loads(self.held.get()[0]) if self.held.exists() else None)
        out = row_of(_OUT)
        for e in sorted(rows, key=lambda e: (e.at_us, e.seq)):
            found = epochs.take(e)
            if found:
                yield out(key[0], e.seq, e.at_us, *found)
        self.held.update((json.dumps(epochs.state),))

    def close(self) -> None:
        pass


def epoch_stream(events: DataFrame) -> DataFrame:
    """Epochs of streaming ``window_events``: those of ``association_epochs`` and ``counter_epochs``
    (where ``since_us`` is the first row of the epoch and there is no identity)."""
    return events.groupBy("session_id").transformWithState(EpochProcessor(), _OUT, "append", "none")
