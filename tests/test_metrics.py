"""Trends and summaries against pandas, and the split of large groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from runledger import LedgerConfig, Metric
from runledger.operators import metrics

CFG = LedgerConfig(metrics=(Metric("tic", "MS1.TIC", "Total current"), Metric("txt", "text", "Text"), Metric("gone", "gone", "Gone")))


def frame(spark, n, start="2024-01-01", project="A", file_type="Sample", values=None):
    values = np.linspace(1e6, 2e6, n) if values is None else values
    pdf = pd.DataFrame({
        "ProjectID": project, "DateTime": pd.date_range(start, periods=n, freq="h"), "FileType": file_type,
        "RawFileName": [f"{project}_{file_type}_{i:05d}" for i in range(n)], "MS1.TIC": [float(v) for v in values], "text": [str(v) for v in values]})
    df = spark.createDataFrame(pdf, "ProjectID string, DateTime timestamp_ntz, FileType string, RawFileName string, `MS1.TIC` double, text string")
    return df.withColumns({"Date": F.to_date("DateTime"), "Error": F.lit(None).cast("string")})


def pandas_trend(values, width=15):
    s = pd.Series(values)
    return s.rolling(width, min_periods=1).median(), s.rolling(width, min_periods=1).std()


def test_standards_are_left_out(spark):
    df = frame(spark, 10).unionByName(frame(spark, 3, file_type="HSstd")).unionByName(frame(spark, 2, file_type="OtherStandard"))
    assert metrics.metric_trends(df, CFG, ["tic"]).count() == 10
    assert metrics.points(metrics.metric_long(df, CFG, ["tic"])).count() == 15


def test_runs_without_a_type_stay(spark):
    df = frame(spark, 7).withColumn("FileType", F.lit(None).cast("string"))
    assert metrics.exclude_standards(metrics.metric_long(df, CFG, ["tic"])).count() == 7
    assert metrics.series_by_type(df, CFG, ["tic"]).count() == 0


def test_missing_values_are_left_out(spark):
    df = frame(spark, 10).withColumn("MS1.TIC", F.when(~F.col("RawFileName").rlike("0000[3-4]$"), F.col("`MS1.TIC`")))
    assert metrics.metric_trends(df, CFG, ["tic"]).count() == 8


def test_rolling_matches_pandas(spark):
    values = np.random.default_rng(1).normal(100, 5, 50)
    got = metrics.metric_trends(frame(spark, 50, values=values), CFG, ["tic"]).orderBy("DateTime").toPandas()
    median, std = pandas_trend(values)
    assert set(got["mode"]) == {"rolling"} and len(got) == 50
    np.testing.assert_array_equal(got["Median"], median)
    np.testing.assert_allclose(got["std"], std, rtol=1e-9)
    np.testing.assert_allclose(got["Lower"], median - std, rtol=1e-9)
    np.testing.assert_allclose(got["Upper"], median + std, rtol=1e-9)


@pytest.mark.parametrize("n,mode", [(5, "none"), (6, "static"), (29, "static"), (30, "rolling")])
def test_thresholds(spark, n, mode):
    df = frame(spark, n)
    trends = metrics.metric_trends(df, CFG, ["tic"])
    assert {r["mode"] for r in trends.collect()} == {mode}
    assert rows(metrics.trend_mode(df, CFG, ["tic"]), "n", "mode") == [(n, mode)]
    summary = metrics.metric_summary(df, CFG, ["tic"]).first()
    values = np.linspace(1e6, 2e6, n)
    if mode == "none":
        assert summary["median"] is None and trends.first()["Median"] is None
    else:
        assert summary["median"] == pytest.approx(np.median(values))
        assert summary["std"] == pytest.approx(np.std(values, ddof=1))
    if mode == "static":
        r = trends.first()
        assert r["Median"] == pytest.approx(np.median(values))
        assert r["Upper"] - r["Lower"] == pytest.approx(2 * np.std(values, ddof=1))


def test_text_numbers_and_absent_columns(spark):
    df = frame(spark, 8).withColumn("text", F.when(F.col("RawFileName").endswith("3"), F.lit("n/a")).otherwise(F.col("text")))
    assert [m.key for m in metrics.resolve_metrics(df, CFG)] == ["tic", "txt"]
    got = rows(metrics.metric_availability(df, CFG), "metric", "n_points", "available")
    assert got == [("tic", 8, True), ("txt", 7, True)]
    nothing = df.withColumn("text", F.lit("x"))
    assert rows(metrics.metric_availability(nothing, CFG, ["txt"]), "available") == [(False,)]
    assert metrics.metric_report(nothing, CFG).select("metric").collect()[0][0] == "tic"
    with pytest.raises(KeyError):
        metrics.metric_long(df, CFG, ["unknown"])
    assert metrics.metric_long(df, CFG, ["gone"]).count() == 0
    assert metrics.metric_counts(df, CFG, ["gone"]).count() == 0
    assert metrics.series_by_type(df, CFG, ["gone"]).count() == 0
    assert metrics.metric_trends(df, CFG, ["gone"]).count() == 0


def test_report_texts_and_order(spark):
    got = metrics.metric_report(frame(spark, 3), CFG).orderBy("ord").collect()
    assert [(r["metric"], r["label"]) for r in got] == [("tic", "Total current"), ("txt", "Text")]
    assert got[0]["mean_text"] == "mean: n/a" and got[0]["std_text"] == "std dev: n/a"
    got = metrics.metric_report(frame(spark, 7, values=[1, 2, 3, 4, 5, 6, 7]), CFG, ["tic"]).first()
    assert (got["mean_text"], got["median_text"], got["std_text"]) == ("mean: 4.00", "median: 4.00", "std dev: 2.16")


def test_series_start_at_their_first_run(spark):
    df = frame(spark, 3, start="2024-01-02").unionByName(frame(spark, 2, start="2024-01-01", file_type="HSstd"))
    got = metrics.series_by_type(df, CFG, ["tic"]).orderBy("first_time").collect()
    assert [(r["FileType"], r["n_points"], r["first_file"]) for r in got] == [
        ("HSstd", 2, "A_HSstd_00000"), ("Sample", 3, "A_Sample_00000")]


def skewed(spark):
    """One project with most rows, many of them at the same time or without one, and small ones."""
    rng = np.random.default_rng(7)
    big = frame(spark, 700, values=np.round(rng.normal(50, 10, 700)))
    serial = F.substring_index("RawFileName", "_", -1).cast("int")
    big = big.withColumn("DateTime", F.when(serial % 3 == 0, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
                         .when(serial % 3 == 1, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("DateTime")))
    df = big
    for i, n in enumerate([3, 10, 29, 30, 45, 70]):
        df = df.unionByName(frame(spark, n, project=f"S{i}", values=rng.normal(5, 1, n)))
    # A metric that few runs of the large project have.
    return df.withColumn("text", F.when((F.col("ProjectID") != "A") | (serial < 12), F.col("text")))


@pytest.mark.parametrize("hot_rows", [5, 60, 650])
def test_split_trends_equal_whole_ones(spark, hot_rows):
    df = skewed(spark).cache()
    whole = metrics.metric_trends(df, CFG)
    split = metrics.metric_trends(df, CFG.with_(hot_rows=hot_rows))
    key = ["ProjectID", "metric", "Name"]
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (whole, split))
    assert len(a) == len(b) == whole.count()
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)
    np.testing.assert_array_equal(a["Median"], b["Median"])


@pytest.mark.parametrize("hot_rows", [5, 60, 650])
def test_split_medians_equal_whole_ones(spark, hot_rows):
    df = skewed(spark).cache()
    key = ["ProjectID", "metric"]
    whole = metrics.metric_summary(df, CFG).toPandas().sort_values(key).reset_index(drop=True)
    split = metrics.metric_summary(df, CFG.with_(hot_rows=hot_rows)).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, split, check_exact=False, rtol=1e-9)
    np.testing.assert_array_equal(whole["median"], split["median"])


def test_number_of_hot_groups_is_bounded(spark):
    from runledger.operators.skew import hot_groups

    counts = spark.createDataFrame([(f"g{i}", 100) for i in range(50)] + [("big", 5000)], "k string, count bigint")
    cfg = CFG.with_(hot_rows=10, max_hot_groups=5)
    rows_ = spark.range(10_000)
    hot = hot_groups(rows_, counts, ["k"], cfg)
    assert [r["k"] for r in hot.collect()] == ["big"]
    assert hot_groups(rows_, counts.where("k <> 'big'"), ["k"], cfg.with_(hot_rows=100)) is None
    assert hot_groups(rows_, counts.limit(0), ["k"], cfg) is None
    assert hot_groups(spark.range(10), counts, ["k"], cfg) is None
