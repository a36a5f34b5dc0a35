"""Pairing of regular and control runs, and the merge, on rows whose outcome is known."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runledger import LedgerConfig, Metric
from runledger.functions import quoted, strip_suffix
from runledger.operators import checks, merge, reports

CFG = LedgerConfig(metrics=(Metric("Metric", "Metric", "A metric"),))
REPORT = "Name string, `System.Time.s` double, Metric double"
SAMPLE = "SampleName_ID string, ProjectID string, CreationDate string"
PROJECT = "ProjectID string, TimeRange string, ProjectName string"
RUNS = [
    ("Proj_A_01_S1", 1755439995.0, 1000.0),
    ("Proj_A_01_S1.raw", 1755439995.0, 2000.0),
    ("Proj_A_01_S1", 1755439995.0, 1000.0),
    ("Proj_A_01_S2.raw", 1755442365.0, 2500.0),
    ("Proj_A_01_S3", 1755439900.0, 3000.0),
]


def merge_rows(spark, runs=RUNS, samples=(), projects=(), cfg=CFG, more=()):
    frames = [spark.createDataFrame(list(runs), REPORT), *more]
    return merge.merge_sources(
        frames, spark.createDataFrame(list(samples), SAMPLE), spark.createDataFrame(list(projects), PROJECT), cfg)


def test_twins_share_a_row_and_copies_collapse(spark):
    df = merge_rows(spark)
    assert rows(df, "RawFileName", "Metric", "Metric_iQC") == [
        ("Proj_A_01_S1", 1000.0, 2000.0), ("Proj_A_01_S2", None, 2500.0), ("Proj_A_01_S3", 3000.0, None)]
    s1 = df.where("RawFileName = 'Proj_A_01_S1'").first()
    assert s1["ProjectID"] == "Proj_A_01" and s1["FileType"] == "Proj_A_01"
    assert s1["DateTime"] == dt.datetime(2025, 8, 17, 14, 13, 15)
    assert s1["Time"] == "14:13:15.000000" and s1["Date"] == dt.date(2025, 8, 17)


def test_column_order(spark):
    assert merge_rows(spark).columns == [
        "Name", "System.Time.s", "Metric", "Name_iQC", "System.Time.s_iQC", "Metric_iQC",
        "SampleName_ID", "CreationDate", "Error", "RawFileName", "ProjectID", "Date", "Time", "DateTime", "FileType",
        "ProjectName"]


def test_same_source_twice_changes_nothing(spark):
    once = rows(merge_rows(spark))
    assert rows(merge_rows(spark, more=[spark.createDataFrame(RUNS, REPORT)])) == once


def test_presence_patterns(spark):
    patterns = [(r, c, m) for r in (0, 1) for c in (0, 1) for m in (0, 1) if r or c or m]
    name = lambda p: "P_a_1_" + "".join(map(str, p))
    runs = [(name(p), 10.0, 1.0) for p in patterns if p[0]] + [(name(p) + ".d", 20.0, 2.0) for p in patterns if p[1]]
    out = {r["RawFileName"]: r for r in merge_rows(spark, runs, [(name(p) + ".raw", None, None) for p in patterns if p[2]]).collect()}
    assert set(out) == {name(p) for p in patterns}
    for regular, control, sample in patterns:
        r = out[name((regular, control, sample))]
        assert r["ProjectID"] == ("P_a_1" if regular or control else "")
        assert r["Metric"] == (1.0 if regular else None) and r["Metric_iQC"] == (2.0 if control else None)
        second = 10 if regular else 20 if control else None
        assert r["DateTime"] == (dt.datetime(1970, 1, 1, 0, 0, second) if second else None)
        assert (r["SampleName_ID"] is not None) == bool(sample)


def test_metadata_wins_over_report(spark):
    r = merge_rows(spark, [("a_b_c_d", 10.0, 1.0)], [("a_b_c_d.raw", "Mine", "2024-05-06 07:08:09")],
                   [("Mine", "2024", "My project")]).first()
    assert r["ProjectID"] == "Mine" and r["ProjectName"] == "My project"
    assert r["DateTime"] == dt.datetime(2024, 5, 6, 7, 8, 9)


def test_report_clock_fills_an_unreadable_creation_date(spark):
    r = merge_rows(spark, [("a_b_c_d", 10.0, 1.0)], [("a_b_c_d", "M", "yesterday")]).first()
    assert r["DateTime"] == dt.datetime(1970, 1, 1, 0, 0, 10)


def test_samples_without_a_name_stay_apart(spark):
    df = merge_rows(spark, [], [(None, "A", None), (None, "B", None)])
    assert rows(df, "RawFileName", "ProjectID") == [(None, "A"), (None, "B")]
    checks.assert_unique(df, "RawFileName")


def test_duplicate_samples_fail_the_uniqueness_check(spark):
    df = merge_rows(spark, [], [("x.raw", "A", None), ("x.d", "A", None)])
    with pytest.raises(checks.DuplicateKeyError, match="'x'"):
        checks.assert_unique(df, "RawFileName")


def test_several_rows_of_a_project_fan_out(spark):
    df = merge_rows(spark, [], [("x", "A", None)], [("A", "1", "one"), ("A", "2", "two")])
    assert rows(df, "RawFileName", "ProjectName") == [("x", "one"), ("x", "two")]


def test_survivor_is_first_source_then_newest_clock(spark):
    a = spark.createDataFrame([("r", 5.0, 1.0), ("r", None, 9.0), ("r", 7.0, 2.0)], REPORT)
    b = spark.createDataFrame([("r", 99.0, 3.0)], REPORT)
    union = reports.union_reports([a, b], CFG)
    assert reports.dedup_regular(union, CFG).first()["Metric"] == 2.0
    assert reports.align_control(union, CFG).first()["Metric"] == 2.0


def test_missing_columns_are_null_and_mixed_types_stay_text(spark):
    a = spark.createDataFrame([("r1", 5.0, "n/a")], "Name string, `System.Time.s` double, Metric string")
    b = spark.createDataFrame([("r2", 5.0, 2.5)], REPORT)
    c = spark.createDataFrame([("r3", 5.0)], "Name string, `System.Time.s` double")
    union = reports.union_reports([a, b, c], CFG)
    assert rows(union, "src_idx", "Name", "Metric") == [(0, "r1", "n/a"), (1, "r2", "2.5"), (2, "r3", None)]


def test_no_name_column_is_an_error(spark):
    with pytest.raises(ValueError, match="required columns"):
        reports.union_reports([spark.createDataFrame([(1.0,)], "Metric double")], CFG)


def test_clashing_columns_are_an_error(spark):
    projects = spark.createDataFrame([("A", "x")], "ProjectID string, FileType string")
    with pytest.raises(ValueError, match="filetype"):
        merge.merge_sources([spark.createDataFrame(RUNS, REPORT)], spark.createDataFrame([], SAMPLE), projects, CFG)


def align_by_join(union, cfg):
    """Pairing by window deduplication and a full outer join."""
    cols = reports.report_columns_of(union)
    name = quoted(cfg.name_column)
    regular = reports.dedup_regular(union, cfg).drop(reports.SOURCE).withColumn(reports.KEY, F.col(name))
    control = reports.suffix_columns(reports.dedup_control(union, cfg).drop(reports.SOURCE))
    control = control.withColumn(reports.KEY, strip_suffix(F.col(quoted(cfg.name_column + reports.CONTROL_TAG))))
    return regular.join(control, reports.KEY, "full_outer").select(
        reports.KEY, *[quoted(c) for c in cols], *[quoted(c + reports.CONTROL_TAG) for c in cols])


def test_both_ways_of_pairing_agree(spark, events, cfg):
    union = reports.union_reports(events.reports, cfg)
    a, b = reports.align_control(union, cfg), align_by_join(union, cfg)
    assert rows(a) == rows(b) and a.count() > 900


def test_error_may_be_a_project_column(spark):
    projects = spark.createDataFrame([("Proj_A_01", "2024", "broken")], "ProjectID string, TimeRange string, Error string")
    got = merge.merge_sources([spark.createDataFrame(RUNS, REPORT)], spark.createDataFrame([], SAMPLE), projects, CFG)
    assert rows(got, "RawFileName", "Error") == [(f"Proj_A_01_S{i}", "broken") for i in (1, 2, 3)]


def test_dedup_is_idempotent(spark, events, cfg):
    union = reports.union_reports(events.reports, cfg)
    once = reports.dedup_regular(union, cfg)
    assert rows(reports.dedup_regular(once, cfg)) == rows(once)


def test_many_copies_of_one_sample_are_split(spark):
    """A key above the limit takes the broadcast path; the outcome is that of the join."""
    samples = [("hot.raw", f"P{i}", None) for i in range(40)] + [(f"s{i}", "Q", None) for i in range(10)] + [(None, "N", None)] * 5
    runs = [("hot", 1.0, 1.0), ("s1", 2.0, 2.0), ("alone", 3.0, 3.0)]
    plain = merge_rows(spark, runs, samples)
    split = merge_rows(spark, runs, samples, cfg=CFG.with_(hot_rows=20))
    assert rows(split) == rows(plain) and split.count() == 56
    assert split.where("RawFileName = 'hot'").select(F.count_distinct("ProjectID")).first()[0] == 40
