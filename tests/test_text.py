import random

from pyspark.sql import functions as F

from linklore.functions import normalize as N
from linklore.functions import text as X


def test_fixed_rounds_the_binary_value_half_to_even(spark):
    rng = random.Random(7)
    values = [0.25, 0.35, 12.35, 2.5, 3.5, 0.5, 99.95, 0.049, -0.04, 1e9 + 0.5, 999.5, 0.0, 1.005, 0.65, 0.005, 0.015, 0.045, 0.05, 0.15, 0.95, 0.995]
    values += [i / 200 for i in range(300)]
    values += [rng.uniform(-1e4, 1e4) for _ in range(500)]
    values += [round(rng.uniform(0, 500), 2) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", *[X.fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2)], X.fixed(F.col("v"), 1, plus=True).alias("p")
    )
    for r in df.collect():
        for d in (0, 1, 2):
            assert r[f"d{d}"] == f"{r.v:.{d}f}", r
        assert r.p == f"{r.v:+.1f}"


def test_ladders_of_units(spark):
    df = spark.createDataFrame(
        [(2.5e9, 3 * 1024**4, 3723), (1.25e6, 1536, 63), (999.0, 12, 59), (0.0, 0, 0)], "x double, n bigint, s bigint"
    ).select(
        X.rate(F.col("x")), X.peak_rate(F.col("x")), X.byte_size(F.col("n")),
        X.duration(F.col("s")), X.duration(F.col("s"), hours_with_seconds=True),
    )
    assert [tuple(r) for r in df.collect()] == [
        ("2.50 Gbps", "2500.0 Mbps", "3.0T", "1h02m", "1h02m03s"),
        ("1.2 Mbps", "1.2 Mbps", "1.5K", "1m03s", "1m03s"),
        ("999 bps", "idle", "12B", "59s", "59s"),
        ("idle", "idle", "0B", "0s", "0s"),
    ]


def test_channel_text(spark):
    cases = {
        "149 (5GHz, 80MHz)": (149, "FiveGhz", "Mhz80"),
        "37 (6GHz, 160MHz)": (37, "SixGhz", "Mhz160"),
        "6 (2GHz, 20MHz)": (6, "TwoPointFourGhz", "Mhz20"),
        "149,80": (149, "FiveGhz", "Mhz80"),
        "11": (11, "TwoPointFourGhz", None),
        " 200 ": (200, "Unknown", None),
        "5 (6 GHz, 30MHz)": (5, "SixGhz", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", N.channel(F.col("v")).alias("c"))
    for r in df.collect():
        assert tuple(r.c) == cases[r.v], r
    none = spark.createDataFrame([("auto",), (None,)], "v string").select(N.channel(F.col("v")).alias("c"))
    assert [r.c for r in none.collect()] == [None, None]


def test_signal_security_and_ping_text(spark):
    df = spark.createDataFrame(
        [
            ("-42 dBm / -97 dBm", "spairport_security_mode_wpa2_personal", "64 bytes: time=7.25 ms"),
            ("-42 dBm", "spairport_security_mode_none", "time=oops time=3 ms"),
            ("n/a / -90 dBm", "", "Request timeout"),
            (None, None, "xtime=9 ms"),
        ],
        "s string, sec string, ping string",
    ).select(
        N.signal_dbm(F.col("s")), N.noise_dbm(F.col("s")), N.security(F.col("sec")), N.ping_ms(F.col("ping"))
    )
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (-42, -97, "Wpa2", 7.25)
    assert rows[1] == (-42, None, "Open", 3.0)
    assert rows[2][0] is None and rows[2][2:] == ("Open", None)
    assert rows[3] == (None, None, None, None)
