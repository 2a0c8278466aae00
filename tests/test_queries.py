"""Every named query against its SQL, and both session layouts against each other."""

import pytest

import __spark_entry__ as entry_point
from linklore.plans import catalog
from linklore.plans.sequence import Layout
from linklore.sources import lens

from .compare import difference, duck, rows_of
from .conftest import DATA

HOUR = lens.HOUR_US
SPLIT = [
    "event_index", "gateway_window", "dns_window", "association_epochs", "signal_window",
    "density_window", "throughput_window", "rolling_median", "step_rate", "link_neighbors",
    "coverage_time", "roams", "landmarks_gateway", "landmarks_throughput",
    "landmarks_around_playhead", "session_roundtrip", "findings",
]


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    assert difference(df, con, entry_point.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(catalog.queries()) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_comparison_notices_a_change(spark, con):
    df = catalog.queries()["session_summary"](spark, DATA).withColumn("wifi", lens.F.col("wifi") + 1)
    assert difference(df, con, entry_point.oracle_sql()["session_summary"])


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", SPLIT)
def test_split_sessions_give_the_same_rows(spark, name):
    operator = catalog.OPERATORS[name]
    whole = catalog.flat(operator(lens.recording(spark, DATA)))
    cut = catalog.flat(operator(lens.recording(spark, DATA, Layout(37, 11 * HOUR))))
    assert rows_of(whole.columns, whole.collect()) == rows_of(cut.columns, cut.collect())


def test_layout_is_chosen_by_the_largest_session(spark):
    log = spark.createDataFrame([("a", i, i * 10) for i in range(100)], "session_id string, seq bigint, at_us bigint")
    from linklore.plans.sequence import WHOLE, choose_layout

    assert choose_layout(log, 100) == WHOLE
    assert choose_layout(log, 25) == Layout(25, 247)


@pytest.mark.parametrize("name", ["gateway_window", "dns_window"])
def test_dense_frames_are_selected_not_collected(spark, name):
    operator = catalog.OPERATORS[name]
    whole = catalog.flat(operator(lens.recording(spark, DATA)))
    dense = catalog.flat(operator(lens.recording(spark, DATA, Layout(37, 11 * HOUR, frame_rows=3))))
    assert rows_of(whole.columns, whole.collect()) == rows_of(dense.columns, dense.collect())


def test_a_larger_log_is_spread_over_more_tasks(spark, monkeypatch):
    from linklore.operators import timeline
    from linklore.plans import sequence

    monkeypatch.setattr(sequence, "ROWS_PER_TASK", 40)
    log = lens.recording(spark, DATA).log()
    layout = sequence.choose_layout(log)
    assert layout.tasks == max(8, -(-log.count() // 40)) > 8 and not layout.split
    wide = timeline.timeline(lens.recording(spark, DATA, layout))
    # Adaptive execution joins no parts of a timeline that was spread.
    assert wide.rdd.getNumPartitions() == layout.tasks
    plain = timeline.timeline(lens.recording(spark, DATA, sequence.WHOLE))
    assert wide.count() == plain.count() and wide.exceptAll(plain).isEmpty()


def test_steps_over_a_larger_log_are_spread(spark, monkeypatch):
    """Access points, lifecycle and landmarks take the tasks of the log, whatever their parts weigh."""
    from linklore.operators import landmarks, lifecycle, timeline
    from linklore.plans import sequence

    monkeypatch.setattr(sequence, "ROWS_PER_TASK", 40)
    layout = sequence.choose_layout(lens.recording(spark, DATA).log())
    wide, plain = (lens.recording(spark, DATA, x) for x in (layout, sequence.WHOLE))
    steps = {
        "channels": timeline.channel_counts,
        "networks": timeline.same_ssid_best,
        "environment": timeline.link_environment,
        # Closings come from one part of the rows each; what is emitted is joined.
        "emitted": lambda r: lifecycle.findings(r).where("lifecycle <> 'Resolved'"),
        "active": lambda r: lifecycle.active_findings(lifecycle.findings(r), r.layout),
        "published": lambda r: landmarks.published(r, lifecycle.findings(r)),
        "health": landmarks.from_health,
        "gateway": landmarks.from_gateway,
        "dns": landmarks.from_dns,
        "throughput": landmarks.from_throughput,
    }
    for name, step in steps.items():
        found, same = step(wide), step(plain)
        parts = found.rdd.getNumPartitions()
        assert parts == layout.tasks, name
        assert rows_of(found.columns, found.collect()) == rows_of(same.columns, same.collect()), name


def test_scan_sizes_are_counted_without_the_pairs(spark):
    """Sizes are those of the neighbours, with repeated scans, repeated items and missing keys."""
    from linklore.plans.sequence import WHOLE

    base = "session_id bigint, seq bigint, at_us bigint"
    scans = spark.createDataFrame(
        [(1, 5, 0), (1, 5, 0), (1, 9, 1), (2, 10, 2), (2, None, 3), (None, 11, 4), (3, 99, 5)], base
    )
    lines = [(7, 1, 3, 1, 4.0), (8, 1, 3, 1, 4.0), (8, 1, 3, 1, 4.0), (9, 2, 5, 2, 9.0), (9, None, 5, 2, 9.0)]
    items = spark.createDataFrame(
        lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"
    )
    for layout in (WHOLE, Layout(tasks=5)):
        counted = lens.neighbor_counts(scans, items, layout)
        listed = lens.neighbors(scans, items, layout).groupBy("session_id", "scan_seq").count()
        assert sorted(map(tuple, counted.collect()), key=repr) == sorted(map(tuple, listed.collect()), key=repr)
        assert counted.count() == 4


def test_findings_to_a_playhead_need_only_what_it_sees(spark):
    from linklore.operators import lifecycle
    from linklore.operators.projections import half_way

    rec = lens.recording(spark, DATA)
    heads = half_way(rec)
    seen = rec.seen_by(heads)
    ends = {r.session_id: r for r in heads.collect()}
    assert sorted(map(tuple, seen.log().collect())) == sorted(
        tuple(r) for r in rec.log().collect() if r.at_us <= ends[r.session_id].playhead_us
    )
    whole, cut = (
        lifecycle.findings(r).join(heads, "session_id").where("at_us <= playhead_us") for r in (rec, seen)
    )
    assert whole.count() > 0
    assert rows_of(whole.columns, whole.collect()) == rows_of(cut.columns, cut.collect())
