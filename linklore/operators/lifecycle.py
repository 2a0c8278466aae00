"""Findings: candidates reduced to lifecycle transitions.

Per session and fingerprint: the first candidate opens an episode (Active);
while it lasts, a confidence that moved materially since the last emission and
after the cooldown emits Escalating or Recovering; the first evaluation without
the candidate, late enough after it was last seen, closes it (Resolved).

Opening and closing are set-based.  Emission inside an episode depends on the
emission before it, so it is a fold: over one array per episode for sessions
that fit a task, and segment by segment for split ones (see ``_chain_*``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..params import Params
from ..plans.sequence import (
    WHOLE,
    Layout,
    last_known,
    materialize,
    previous,
    running,
    running_max,
    running_min,
    scan,
    settle,
    spread,
)
from ..sources.recording import Recording
from . import rules as R
from .timeline import INSTANT, instants, slice_of, timeline

FINGERPRINT = ["session_id", "fingerprint"]
EPISODE = [*FINGERPRINT, "episode"]


def findings(
    rec: Recording, rules: dict[str, R.Rule] | None = None, every_tick: bool | None = None
) -> DataFrame:
    """The whole pipeline: windows, timeline, rules, lifecycle.

    The built-in rules see nothing new at the ticks deep inside a silence, so these are not
    generated; rules of the caller's own may read the time itself and are run at every tick."""
    every = rules is not None if every_tick is None else every_tick
    candidates = R.match(timeline(rec, R.needed(rules), every), rec.params, rules)
    found = transitions(candidates, instants(rec, every), rec.params, rec.layout)
    rendered = R.render(found, rec.params, rules)
    return rendered.withColumn(
        "headline", L.lifecycle_headline(F.col("headline"), F.col("lifecycle"))
    )


def transitions(
    candidates: DataFrame, evaluations: DataFrame, p: Params, layout: Layout
) -> DataFrame:
    """Lifecycle transitions of unrendered ``candidates``; ``evaluations`` are
    all instants at which the rules ran, firing or not.

    Candidates and episodes are each read several times below, so both are
    written once instead of being derived again for every reader."""
    candidates = materialize(candidates)
    closings = _closings(candidates, evaluations, p, layout)
    rows = candidates.withColumn("closes", F.lit(0)).unionByName(
        closings.withColumn("closes", F.lit(1)), allowMissingColumns=True
    )
    order = [*INSTANT, "closes"]
    rows = scan(
        spread(rows, layout),
        FINGERPRINT,
        layout,
        order,
        slice_of(layout),
        closed=running(F.col("closes")),
        last=previous("kind", "numbers", "words"),
    )
    # A closing row still belongs to the episode it closes.
    rows = rows.withColumn("episode", F.col("closed") - F.col("closes")).drop("closed")
    rows = scan(
        rows,
        EPISODE,
        layout,
        order,
        slice_of(layout),
        peak=running_max(F.col("confidence")),
        first_seen_us=running_min(F.col("at_us")),
    )
    rows = materialize(rows)
    marks = rows.where("closes = 0").select(*EPISODE, *INSTANT, "confidence")
    chain = _chain_split if layout.split else _chain_whole
    row = [*EPISODE, *INSTANT]
    emitted = spread(chain(marks, p, layout), layout, *row).join(
        spread(rows.where("closes = 0"), layout, *row), row
    )
    closed = rows.where("closes = 1").withColumn("lifecycle", F.lit("Resolved"))
    return _finding(emitted, False).unionByName(_finding(closed, True))


def _finding(df: DataFrame, resolved: bool) -> DataFrame:
    src = "last." if resolved else ""
    confidence = F.lit(0.0) if resolved else F.col("confidence")
    return df.select(
        "session_id",
        *INSTANT,
        F.col(f"{src}kind").alias("kind"),
        "fingerprint",
        L.float32(L.clamp01(confidence)).alias("confidence"),
        L.float32(L.clamp01(F.col("peak"))).alias("peak_confidence"),
        F.col(f"{src}numbers").alias("numbers"),
        F.col(f"{src}words").alias("words"),
        "lifecycle",
        "first_seen_us",
        F.col("at_us").alias("last_seen_us"),
    )


def _closings(
    candidates: DataFrame, evaluations: DataFrame, p: Params, layout: Layout
) -> DataFrame:
    """One row per resolution: the instant at which a fingerprint is closed."""
    late = p.us(p.resolved_after)
    candidates = spread(candidates.select(*FINGERPRINT, *INSTANT), layout)
    seen = scan(
        candidates,
        FINGERPRINT,
        layout,
        INSTANT,
        slice_of(layout),
        prev=previous("at_us"),
    )
    # A silence long enough to resolve, and what ends it (nothing, at the end).
    silences = seen.where(F.col("at_us") - F.col("prev.at_us") >= late).select(
        *FINGERPRINT, (F.col("prev.at_us") + late).alias("due_us"), F.struct(*INSTANT).alias("until")
    )
    final = candidates.groupBy(*FINGERPRINT).agg((F.max("at_us") + late).alias("due_us"))
    due = silences.unionByName(final, allowMissingColumns=True)

    # First evaluation at or after ``due_us``: walk the merged timeline backward.
    merged = evaluations.select(
        "session_id",
        *INSTANT,
        F.lit(0).alias("asks"),
        F.struct(*INSTANT).alias("instant"),
    ).unionByName(
        due.select(
            "session_id",
            F.col("due_us").alias("at_us"),
            F.lit(1).alias("asks"),
            "fingerprint",
            "until",
        ),
        allowMissingColumns=True,
    )
    merged = merged.select(
        "*",
        (-F.col("at_us")).alias("back_us"),
        (-F.col("is_tick")).alias("back_tick"),
        (-F.col("seq")).alias("back_seq"),
    )
    merged = scan(
        spread(merged, layout),
        ["session_id"],
        layout,
        ["back_us", "asks", "back_tick", "back_seq"],
        slice_of(layout, "back_us"),
        found=last_known(F.col("instant")),
    )
    hit = F.col("found").isNotNull() & (F.col("until").isNull() | (F.col("found") < F.col("until")))
    return merged.where((F.col("asks") == 1) & hit).select(*FINGERPRINT, "found.*")


# -- emission chain --------------------------------------------------------


def _material(delta, p: Params):
    return F.abs(delta) >= L.f32(p.material_delta)


def _chain_whole(marks: DataFrame, p: Params, layout: Layout) -> DataFrame:
    """Fold an episode's (time, confidence) pairs inside the JVM."""
    step = F.struct(*INSTANT, "confidence")
    ordered = spread(marks, layout).groupBy(*EPISODE).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    hit = "struct<at_us:bigint,is_tick:int,seq:bigint,lifecycle:string>"
    start = F.struct(
        F.lit(None).cast("bigint").alias("at_us"),
        F.lit(None).cast("float").alias("confidence"),
        F.array().cast(f"array<{hit}>").alias("hits"),
    )

    def merge(acc, x):
        delta = x["confidence"] - acc["confidence"]
        cooled = x["at_us"] - acc["at_us"] >= p.us(p.cooldown)
        opens = acc["at_us"].isNull()
        lifecycle = (
            F.when(opens, "Active").when(delta > 0, "Escalating").otherwise("Recovering")
        )
        emits = opens | (_material(delta, p) & cooled)
        new = F.struct(x["at_us"], x["is_tick"], x["seq"], lifecycle.alias("lifecycle")).cast(hit)
        return F.when(
            emits,
            F.struct(
                x["at_us"].alias("at_us"),
                x["confidence"].alias("confidence"),
                F.concat(acc["hits"], F.array(new)).alias("hits"),
            ),
        ).otherwise(acc)

    folded = F.aggregate("steps", start, merge, lambda acc: acc["hits"])
    return ordered.select(*EPISODE, F.explode(folded).alias("hit")).select(*EPISODE, "hit.*")


def _first_hit(at, conf, start: int, t_in: int, c_in, cooldown: int, delta) -> int:
    """First position from ``start`` that emits after an emission (t_in, c_in)."""
    i = max(start, int(np.searchsorted(at, t_in + cooldown, side="left")))
    while i < len(at):
        block = np.abs(conf[i : i + 1024] - c_in) >= delta
        if block.any():
            return i + int(block.argmax())
        i += 1024
    return len(at)


def _chain_split(marks: DataFrame, p: Params, layout: Layout) -> DataFrame:
    """The same fold without an episode in one task.

    After an emission the fold's state is just that row's time and confidence,
    so a segment is a function from the state it is entered with to the state it
    is left with.  Where a segment can be entered is known beforehand: at a row
    within the cooldown of its start, or at a row where confidence reaches a new
    high or low.  Each segment is reduced to those entries and the state each
    one leads to; the entries of an episode are then walked in order (few rows),
    and every segment replays its part from its real entry state.
    """
    cooldown, delta = p.us(p.cooldown), np.float32(p.material_delta)
    marks = settle(marks.withColumn("segment", slice_of(layout)), layout)
    keys = [*EPISODE, "segment"]
    fields = {f.name: f.dataType.simpleString() for f in marks.schema}
    key_ddl = ", ".join(f"{k} {fields[k]}" for k in keys)

    def summarize(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INSTANT)
        at, conf = pdf["at_us"].to_numpy(), pdf["confidence"].to_numpy(np.float32)
        early = int(np.searchsorted(at, at[0] + cooldown, side="left"))
        rest = conf[early:]
        high = np.maximum.accumulate(rest)
        low = np.minimum.accumulate(rest)
        new = np.ones(len(rest), dtype=bool)
        new[1:] = (rest[1:] > high[:-1]) | (rest[1:] < low[:-1])
        entries = [*range(early), *(early + np.flatnonzero(new))]
        leads: dict[int, int] = {}
        for e in reversed(entries):
            path, i = [], int(e)
            while i not in leads:
                path.append(i)
                nxt = _first_hit(at, conf, i + 1, at[i], conf[i], cooldown, delta)
                if nxt == len(at):
                    leads[i] = i
                    break
                i = nxt
            for j in path:
                leads[j] = leads[i]
        out = [leads[int(e)] for e in entries]
        return pd.DataFrame(
            [[*key, at[entries], conf[entries], at[out], conf[out]]],
            columns=[*keys, "at", "conf", "out_at", "out_conf"],
        )

    summaries = marks.groupBy(*keys).applyInPandas(
        summarize,
        f"{key_ddl}, at array<bigint>, conf array<float>, out_at array<bigint>, out_conf array<float>",
    )

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = None, []
        for r in pdf.sort_values("segment").itertuples():
            rows.append([*key, r.segment, state is not None, *(state or (0, 0.0))])
            at, conf = np.asarray(r.at), np.asarray(r.conf, dtype=np.float32)
            i = 0
            if state:
                i = _first_hit(at, conf, 0, state[0], np.float32(state[1]), cooldown, delta)
            if i < len(at):
                state = (int(r.out_at[i]), float(r.out_conf[i]))
        return pd.DataFrame(rows, columns=[*keys, "entered", "in_at", "in_conf"])

    entries = summaries.groupBy(*EPISODE).applyInPandas(
        walk, f"{key_ddl}, entered boolean, in_at bigint, in_conf float"
    )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INSTANT)
        at, conf = pdf["at_us"].to_numpy(), pdf["confidence"].to_numpy(np.float32)
        hits, words = [], []
        if not pdf["entered"].iloc[0]:
            hits, words, i = [0], ["Active"], 0
            last_at, last = at[0], conf[0]
        else:
            i, last_at, last = -1, int(pdf["in_at"].iloc[0]), np.float32(pdf["in_conf"].iloc[0])
        while True:
            i = _first_hit(at, conf, i + 1, last_at, last, cooldown, delta)
            if i == len(at):
                break
            hits.append(i)
            words.append("Escalating" if conf[i] > last else "Recovering")
            last_at, last = at[i], conf[i]
        out = pdf.iloc[hits][[*EPISODE, *INSTANT]].copy()
        out["lifecycle"] = words
        # Plain strings: Arrow-backed ones may reach Spark as chunked arrays.
        return out.astype({"fingerprint": object, "lifecycle": object})

    episode_ddl = ", ".join(f"{k} {fields[k]}" for k in [*EPISODE, *INSTANT])
    return (
        marks.join(entries, keys)
        .groupBy(*keys)
        .applyInPandas(replay, f"{episode_ddl}, lifecycle string")
    )


def active_findings(found: DataFrame, layout: Layout = WHOLE) -> DataFrame:
    """Latest transition per fingerprint, unless it resolved."""
    newest = F.max_by(
        F.struct(*[c for c in found.columns if c not in FINGERPRINT]), F.struct(*INSTANT)
    )
    return (
        spread(found, layout)
        .groupBy(*FINGERPRINT)
        .agg(newest.alias("f"))
        .where("f.lifecycle <> 'Resolved'")
        .select(*FINGERPRINT, "f.*")
    )
