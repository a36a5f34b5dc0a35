"""Project questions, detail tables and exports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runledger import LedgerConfig
from runledger.operators import detail, projects
from runledger.plans.reports import report_tables
from runledger.sources import export

SLICE = "ProjectID string, DateTime timestamp_ntz, RawFileName string, Error string"


def table(spark, data):
    return spark.createDataFrame(data, SLICE).withColumn("Date", F.to_date("DateTime"))


def day(n, year=2024):
    return dt.datetime(year, 1, n)


def test_valid_error_split(spark):
    df = table(spark, [("A", day(i + 1), f"f{i}", "bad" if i == 9 else None) for i in range(10)])
    valid, failed = projects.split_valid_error(df)
    assert (valid.count(), failed.count()) == (9, 1)
    assert rows(projects.error_table(df)) == [("A", "f9", "bad")]
    assert projects.error_table(df).columns == ["ProjectID", "Rawfile Name", "Error"]


def test_old_date_is_an_error_and_no_date_is_none(spark):
    df = table(spark, [("A", day(1, 1970), "old", None), ("A", None, "none", None), ("A", day(1), "new", None)])
    valid, failed = projects.split_valid_error(df)
    assert rows(valid, "RawFileName") == [("new",), ("none",)]
    assert rows(failed, "RawFileName") == [("old",)]


def test_newest_project_first(spark):
    df = table(spark, [("Old", day(1), "a", None), ("New", day(1, 2025), "b", None), ("Old", day(2), "c", None), ("No", None, "d", None)])
    assert [r[0] for r in projects.projects_by_recency(df).collect()] == ["New", "Old", "No"]
    assert [r[0] for r in projects.project_page(df, 1).collect()] == ["New"]
    assert [r[0] for r in projects.search_projects(df, "OL").collect()] == ["Old"]
    assert [r[0] for r in projects.search_projects(df, None, 2).collect()] == ["New", "Old"]
    assert projects.search_projects(df, "%").count() == 0


def test_empty_table(spark):
    df = table(spark, [])
    assert projects.projects_by_recency(df).count() == 0
    assert projects.project_overview(df, LedgerConfig()).count() == 0


def test_like_reads_wildcards_and_exact_does_not(spark):
    df = table(spark, [(p, day(1), p, None) for p in ("Proj_A_01", "ProjXA_01", "Pro\\A", "Other")])
    names = lambda p, m: [r[0] for r in rows(projects.project_slice(df, p, m), "ProjectID")]
    assert names("Proj_A_01", "like") == ["ProjXA_01", "Proj_A_01"]
    assert names("Proj_A_01", "exact") == ["Proj_A_01"]
    assert names("Pro\\A", "like") == ["Pro\\A"]
    with pytest.raises(ValueError):
        projects.project_slice(df, "x", "regex")


def test_slice_order_and_last_measured(spark):
    df = table(spark, [("A", None, "z", None), ("A", day(2), "b", None), ("A", day(2), "a", "bad"), ("A", day(1), "c", None),
                       ("B", day(3), "x", None), ("B", day(3), "y", None)])
    assert [r["RawFileName"] for r in projects.project_slice(df, "A").collect()] == ["c", "a", "b", "z"]
    assert rows(projects.last_measured(df), "ProjectID", "last_measured", "last_measured_time") == [
        ("A", "z", None), ("B", "y", day(3))]


def test_overview(spark):
    df = table(spark, [("A", day(1), f"f{i}", None) for i in range(75)] + [("A", day(2), "e", "bad"), ("B", day(1), "g", None)])
    got = rows(projects.project_overview(df, LedgerConfig()), "ProjectID", "n_valid", "n_error", "single_column", "last_measured")
    assert got == [("A", 75, 1, True, "e"), ("B", 1, 0, False, "g")]


def test_detail_values_in_first_seen_order(spark):
    cfg = LedgerConfig()
    data = [("A", day(i), f"f{i}", None, ms, lc, method) for i, (ms, lc, method) in enumerate(
        [("M2", None, "C:\\x\\slow.meth"), ("M1", "L1", "C:\\y\\slow.meth"), ("M2", "L1", "C:\\x\\fast.meth")], 1)]
    data.append(("A", day(4), "f4", "bad", "M9", "L9", "no"))
    df = spark.createDataFrame(data, SLICE + ", MSInstrument string, HPLCInstrument string, InstrumentMethod_print string")
    got = detail.in_first_seen_order(detail.project_detail(df.withColumn("Date", F.to_date("DateTime")), cfg)).collect()
    assert [(r["column"], r["value"], r["n_runs"]) for r in got] == [
        ("MSInstrument", "M2", 2), ("MSInstrument", "M1", 1), ("HPLCInstrument", "not available", 1), ("HPLCInstrument", "L1", 2),
        ("InstrumentMethod", "slow.meth", 2), ("InstrumentMethod", "fast.meth", 1)]


def test_export(spark, merged, tmp_path):
    path = export.export_project_csv(merged, "P1_click_B1", str(tmp_path))
    assert path.endswith("P1_click_B1_ProjectData.csv")
    back = spark.read.option("header", True).csv(path)
    want = [r["RawFileName"] for r in projects.project_slice(merged, "P1_click_B1").collect()]
    assert [r["RawFileName"] for r in back.collect()] == want and want
    assert back.columns == merged.columns
    assert export.export_project_csv(merged, "no such", str(tmp_path)) is None


def test_export_of_all_projects(spark, merged, tmp_path):
    odd = merged.limit(2).withColumn("ProjectID", F.lit("")).unionByName(merged.limit(1).withColumn("ProjectID", F.lit(None).cast("string")))
    all_rows = merged.unionByName(odd)
    export.export_all_csv(all_rows, str(tmp_path / "all"))
    back = spark.read.option("header", True).csv(str(tmp_path / "all"))
    assert back.count() == all_rows.count() and set(back.columns) == {*merged.columns, "project"}
    name = "P1_click_B1"
    one = back.where(F.col("project") == f"id:{name}")
    assert one.count() == merged.where(F.col("ProjectID") == name).count() == one.where(F.col("ProjectID") == name).count()
    assert back.where("project = 'id:'").count() == 2 + merged.where("ProjectID = ''").count()
    assert back.where("project = 'none'").count() == 1 + merged.where("ProjectID IS NULL").count()


def test_report_tables(spark, merged, cfg):
    name = "P1_click_B1"
    out = report_tables(merged, name, cfg, ["m2", "m1"], match="exact")
    assert set(out) == {"overview", "detail", "errors", "metrics", "points", "series", "trends"}
    assert [r["metric"] for r in out["metrics"].collect()] == ["m1", "m2"]
    assert {r[0] for r in out["trends"].select("metric").distinct().collect()} <= {"m1", "m2"}
    assert out["overview"].first()["ProjectID"] == name
    assert report_tables(merged, "no such", cfg)["metrics"].count() == 0
