"""Column functions on the values where engines and languages differ."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import functions as fn
from runledger import LedgerConfig, Metric


def apply(spark, values, make, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_strip_suffix(spark):
    values = ["a.raw", "a.d", "a.raw.raw", "a.RAW", "a.raw\n", "a", ".d", "", None, "a.d.raw"]
    assert apply(spark, values, fn.strip_suffix) == ["a", "a", "a.raw", "a.RAW", "a.raw\n", "a", "", "", None, "a.d"]


def test_is_control(spark):
    assert apply(spark, ["a.raw", "a.d", "a.raw\n", "ad", None], fn.is_control) == [True, True, False, False, None]


def test_derive_project(spark):
    values = ["a_b_c_d", "a_b_c", "a_b", "a", "", "a__c_d", "_b", "a_b_c_", None]
    assert apply(spark, values, fn.derive_project) == ["a_b_c", "a_b_c", "a_b", "a", "", "a__c", "_b", "a_b_c", ""]


def test_strip_last_token(spark):
    values = ["a_b_c", "a", "a_", "_", "é_ü", None]
    assert apply(spark, values, fn.strip_last_token) == ["a_b", "a", "a", "", "é", None]


def test_file_type(spark):
    values = ["p_HSstd_1", "p_Standard_1", "p_[Ss]tandar[dt]_1", "p_x_1", None]
    assert apply(spark, values, fn.file_type) == ["HSstd", "p_Standard", "OtherStandard", "p_x", None]
    assert apply(spark, values[1:3], lambda c: fn.file_type(c, "pattern")) == ["OtherStandard", "p_[Ss]tandar[dt]"]


def test_epoch_rounds_half_to_even(spark):
    second = dt.datetime(1970, 1, 1)
    values = [0.5, 1.5, 2.5, 1.7, -0.6, None]
    expected = [0, 2, 2, 2, -1]
    assert apply(spark, values, fn.epoch_to_timestamp, "double") == [second + dt.timedelta(seconds=s) for s in expected] + [None]
    assert apply(spark, ["1755439995", "1.7", "x"], fn.epoch_to_timestamp) == [
        dt.datetime(2025, 8, 17, 14, 13, 15), dt.datetime(1970, 1, 1, 0, 0, 2), None]


def test_epoch_does_not_depend_on_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert apply(spark, [1755439995.0], fn.epoch_to_timestamp, "double") == [dt.datetime(2025, 8, 17, 14, 13, 15)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_time_texts_do_not_depend_on_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    times = [dt.datetime(2024, 3, 10, 2, 30, 5, 1200), dt.datetime(2024, 1, 1), None]  # the first is skipped in New York
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert apply(spark, times, fn.time_of_day, "timestamp_ntz") == ["02:30:05.001200", "00:00:00.000000", None]
        assert apply(spark, times, fn.format_second, "timestamp_ntz") == ["2024-03-10 02:30:05", "2024-01-01 00:00:00", None]
        assert apply(spark, times, fn.format_minute, "timestamp_ntz") == ["2024-03-10 02:30", "2024-01-01 00:00", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_to_number(spark):
    values = ["1", " 1.5 ", "-2e3", ".5", "5.", "12d", "1_000", "n/a", "", "NaN", "inf", None]
    assert apply(spark, values, lambda c: fn.to_number(c, T.StringType())) == [
        1.0, 1.5, -2000.0, 0.5, 5.0, None, None, None, None, None, None, None]
    assert apply(spark, [1.0, float("nan"), None], lambda c: fn.to_number(c, T.DoubleType()), "double") == [1.0, None, None]
    assert apply(spark, [1, None], lambda c: fn.to_number(c, T.IntegerType()), "int") == [1.0, None]


def test_format_2dp_rounds_the_stored_value(spark):
    import random

    rng = random.Random(4)
    values = [0.125, 0.375, 2.675, 1.005, 0.005, 0.015, 0.0049999, -0.001, -0.0, 0.0, 1e15 + 0.125, 2.0**52 + 0.5, 9007199254740993.0, 5e-324, 0.0625, 0.06249999999999999]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 14) for _ in range(500)] + [rng.randint(0, 10**6) / 1000 for _ in range(500)]
    assert apply(spark, values, fn.format_2dp, "double") == [f"{v:.2f}" for v in values]


def test_format_2dp(spark):
    assert apply(spark, [123.456, 0.001, 1234567.0, None, float("nan")], fn.format_2dp, "double") == [
        "123.46", "0.00", "1234567.00", "n/a", "n/a"]


def test_clean_text_and_base_name(spark):
    assert apply(spark, ["a\\b", None, ""], fn.clean_text) == ["a/b", "not available", ""]
    assert apply(spark, ["C:/m/x.meth", "x", "a/b/", "a/b//", "/", "", "a/."], fn.base_name) == [
        "x.meth", "x", "b", "b", "", "", "a"]


def test_contains_ci_is_no_pattern(spark):
    assert apply(spark, ["P_1", "PX1", "xp_1y"], lambda c: fn.contains_ci(c, "P_1")) == [True, False, True]


def test_texts(spark):
    df = spark.createDataFrame(
        [(0, "f", dt.datetime(2024, 1, 2, 3, 4, 59)), (1, "f", None), (2, None, None), (3, "", None)],
        "i int, f string, t timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(fn.last_measured_text(F.col("f"), F.col("t"))).collect()]
    assert got == ["Last measured: f Time: 2024-01-02 03:04", "Last measured: f", "", ""]
    df = spark.createDataFrame([(0, 5), (1, 0), (2, None), (3, -2)], "i int, n int").withColumn(
        "t", F.lit("2024-01-02 03:04:59").cast("timestamp_ntz"))
    got = [r[0] for r in df.orderBy("i").select(fn.refreshed_text(F.col("t"), F.col("n"))).collect()]
    assert got == ["Data refreshed 2024-01-02 03:04 · +5 samples"] + ["Data refreshed 2024-01-02 03:04"] * 3


def test_config_bounds():
    for bad in ({"polling_seconds": 0}, {"rolling_threshold": 1}, {"layout_threshold": 0}, {"recent_rows": 1},
                {"standards_mode": "x"}, {"metrics": (Metric("a", "x", "l"), Metric("a", "y", "l"))}):
        with pytest.raises(ValueError):
            LedgerConfig(**bad)


def test_catalogue():
    cfg = LedgerConfig()
    assert len(cfg.metrics) == 14
    assert cfg.metric("Intensity_50_iQC").merged_column == "Intensity.50._iQC"
    assert cfg.metric("precision_50").merged_column == "precision.50."
    assert cfg.report_columns[:3] == ["Name", "System.Time.s", "Protein"] and len(cfg.report_columns) == 14
    with pytest.raises(KeyError):
        cfg.metric("nope")
