"""Finding lifecycle on a live stream of evaluations.

State per session is one row for each open episode.  A micro-batch puts these rows
in front of its own and derives all transitions of a fingerprint from arrays of
times and confidences; across batches arrival order is the truth, as it is for a live
recorder.  When a session falls silent, an event-time timeout closes what is due.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import DEFAULTS, Params

OUTPUT = (
    "session_id string, at_us bigint, kind string, fingerprint string, confidence float, "
    "peak_confidence float, lifecycle string, first_seen_us bigint, last_seen_us bigint, "
    "numbers array<double>, words array<string>"
)
_INSTANT = ["at_us", "is_tick", "seq"]
_NOTHING = pd.DataFrame({c: [] for c in ("at_us", "pos", "fingerprint", "kind", "confidence", "numbers", "words")})


def evaluations(candidates: DataFrame, instants: DataFrame) -> DataFrame:
    """Every evaluation instant, with its candidates or one row without."""
    return instants.join(candidates, ["session_id", *_INSTANT], "left")


#: What is kept of an episode that is still open; ``at`` is its last sighting.
_OPEN = ["fingerprint", "kind", "at", "first", "emitted", "shown", "peak", "numbers", "words"]


def _transitions(sightings: pd.DataFrame, instants: np.ndarray, p: Params) -> tuple[list[dict], dict | None]:
    """Transitions of one fingerprint, and its episode if one stays open.

    ``sightings`` are in order, with ``pos``, the number of their instant (-1 for the
    carried last sighting of an open episode).  A sighting ends its episode when some
    instant before the next sighting lies far enough behind it; all gaps are looked up at
    once.  Inside an episode only transitions are stepped through: the next one is the
    first row past the cooldown that differs enough from what was last shown.
    """
    at, pos = sightings["at"].to_numpy(np.int64), sightings["pos"].to_numpy(np.int64)
    level = sightings["confidence"].to_numpy(np.float32)
    due = np.searchsorted(instants, at + p.us(p.resolved_after))
    ends = np.flatnonzero(due < np.append(pos[1:], len(instants)))
    out, left = [], None
    for lo, hi in zip(np.append(0, ends + 1), np.append(ends, len(at) - 1)):
        if lo > hi:
            break
        head = sightings.iloc[lo]
        peak = np.maximum.accumulate(np.append(head["peak"], level[lo : hi + 1]).astype(np.float32))[1:]
        fresh = pos[lo] >= 0
        first = int(at[lo]) if fresh else int(head["first"])
        emitted, shown = (int(at[lo]), level[lo]) if fresh else (int(head["emitted"]), np.float32(head["shown"]))

        def told(k: int, when: int, confidence: float, lifecycle: str) -> dict:
            row = sightings.iloc[k]
            return {"at_us": when, "kind": row["kind"], "fingerprint": row["fingerprint"], "confidence": float(confidence),
                    "peak_confidence": float(peak[k - lo]), "lifecycle": lifecycle, "first_seen_us": first,
                    "last_seen_us": when, "numbers": row["numbers"], "words": row["words"]}

        if fresh:
            out.append(told(lo, int(at[lo]), level[lo], "Active"))
        k = lo
        while True:
            rest = slice(k + 1, hi + 1)
            news = (at[rest] - emitted >= p.us(p.cooldown)) & (np.abs(level[rest] - shown) >= np.float32(p.material_delta))
            if not news.any():
                break
            k += 1 + int(np.argmax(news))
            out.append(told(k, int(at[k]), level[k], "Escalating" if level[k] > shown else "Recovering"))
            emitted, shown = int(at[k]), level[k]
        if hi in ends:
            out.append(told(hi, int(instants[due[hi]]), 0.0, "Resolved"))
        else:
            row = sightings.iloc[hi]
            left = {"fingerprint": row["fingerprint"], "kind": row["kind"], "at": int(at[hi]), "first": first, "emitted": emitted,
                    "shown": float(shown), "peak": float(peak[-1]), "numbers": row["numbers"], "words": row["words"]}
    return out, left


def _advance(held: list[dict], rows: pd.DataFrame, instants: np.ndarray, p: Params) -> tuple[list[dict], list[dict]]:
    """Transitions of one session's rows at these instants, and the episodes left open."""
    columns = [*_OPEN, "pos", "confidence"]
    carried = pd.DataFrame(held, columns=_OPEN).assign(pos=-1)
    carried["confidence"] = carried["peak"]
    seen = rows.assign(at=rows["at_us"], first=None, emitted=None, shown=None, peak=-np.inf)
    seen["numbers"] = [[float(x) for x in v] for v in seen["numbers"]]
    seen["words"] = [list(v) for v in seen["words"]]
    every = pd.DataFrame(carried[columns].values.tolist() + seen[columns].values.tolist(), columns=columns)
    out, left = [], []
    for _, sightings in every.groupby("fingerprint", sort=True):
        told, open_ = _transitions(sightings, instants, p)
        out += told
        left += [open_] if open_ else []
    return out, left


def finding_stream(evaluated: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Transitions of a streaming :func:`evaluations` frame that carries a
    watermarked ``at`` timestamp."""

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            rows, instants = _NOTHING, np.array([state.getCurrentWatermarkMs() * 1000])
        else:
            rows = pd.concat(list(batches)).sort_values(_INSTANT)
            rows["pos"] = rows.groupby(_INSTANT, sort=False).ngroup()
            instants = rows.drop_duplicates("pos")["at_us"].to_numpy(np.int64)
            rows = rows[rows["fingerprint"].notna()]
        out, held = _advance(held, rows, instants, p)
        if held:
            state.update((json.dumps(held),))
            due = min(h["at"] for h in held) + p.us(p.resolved_after)
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            found = pd.DataFrame(out)
            found.insert(0, "session_id", key[0])
            yield found.astype({c: object for c in ("session_id", "kind", "fingerprint", "lifecycle")})

    return (
        evaluated.withColumn("session_id", F.col("session_id").cast("string"))
        .groupBy("session_id")
        .applyInPandasWithState(
            step, OUTPUT, "active string", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
