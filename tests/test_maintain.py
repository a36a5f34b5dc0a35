"""Trends that follow upserts, against all trends computed anew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runledger.operators import maintain, metrics
from runledger.plans.refresh import upsert_with_trends
from runledger.sources.store import MergedTable
from runledger.sources.trends import TrendTable
from test_metrics import CFG, frame, skewed

KEY = ["ProjectID", "metric", "DateTime", "Name", "value", "FileType"]


def assert_same(a, b):
    a, b = (x.toPandas() for x in (a, b))
    assert len(a) == len(b)
    a, b = (x.sort_values(KEY, na_position="last").reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-9)


def stored(spark, tmp_path, df):
    table, trends = MergedTable(spark, str(tmp_path / "table"), CFG), TrendTable(spark, str(tmp_path / "trends"), CFG)
    table.replace(df)
    trends.rebuild(table)
    return table, trends


def put(table, trends, rows):
    part = table.stage(rows)
    given = table.staged(part)
    n = given.count()
    known = table.rows_of(given.select("RawFileName"), n).count()
    upsert_with_trends(table, part, n, n - known, trends)


def test_changes_of_every_kind(spark, tmp_path):
    df = skewed(spark)
    table, trends = stored(spark, tmp_path, df)
    rng = np.random.default_rng(5)
    changes = [
        # New values, also of runs that share their time or have none.
        df.where("RawFileName IN ('A_Sample_00010', 'A_Sample_00300', 'A_Sample_00301', 'S4_Sample_00044')").withColumn("MS1.TIC", F.lit(77.0)),
        # Runs that fail, lose their number, become standards, or move in time or to another project.
        df.where("RawFileName = 'A_Sample_00020'").withColumn("Error", F.lit("lost"))
        .unionByName(df.where("RawFileName = 'A_Sample_00040'").withColumn("MS1.TIC", F.lit(None).cast("double")))
        .unionByName(df.where("RawFileName = 'A_Sample_00041'").withColumn("FileType", F.lit("HSstd")))
        .unionByName(df.where("RawFileName = 'A_Sample_00002'").withColumn("DateTime", F.lit("2024-01-20 07:00:00").cast("timestamp_ntz")))
        .unionByName(df.where("RawFileName = 'S5_Sample_00005'").withColumn("ProjectID", F.lit("S2"))),
        # Groups that pass the thresholds in both directions: 30 runs lose one, 29 gain some.
        df.where("RawFileName = 'S3_Sample_00007'").withColumn("Error", F.lit("lost")).unionByName(frame(spark, 4, "2024-03-01", "S2", "Late", rng.normal(5, 1, 4))),
        # A new project.
        frame(spark, 8, project="N"),
        df.limit(0),
    ]
    for rows in changes:
        put(table, trends, rows)
        assert_same(trends.read(), metrics.metric_trends(table.read(), CFG))
    assert trends.manifests.latest()[1]["of"] == table.number and len(trends.manifests.latest()[1]["parts"]) == len(changes)


def test_few_rows_are_computed(spark):
    now = frame(spark, 2000)
    before = now.where("RawFileName IN ('A_Sample_00500', 'A_Sample_01990')").withColumn("MS1.TIC", F.lit(1.0))
    after = now.where("RawFileName IN ('A_Sample_00500', 'A_Sample_01990')")
    rows = maintain.changed_trends(now, before, after, CFG, ["tic"])
    names = {int(r.Name[-5:]) for r in rows.collect()}
    assert set(range(500, 515)) | set(range(1990, 2000)) <= names and len(names) <= 27


def test_parts_are_merged_and_lost_steps_found(spark, tmp_path, monkeypatch):
    from runledger.sources import trends as module

    monkeypatch.setattr(module, "MAX_PARTS", 2)
    df = frame(spark, 40).unionByName(frame(spark, 12, project="B"))
    table, trends = stored(spark, tmp_path, df)
    for i in range(3):
        put(table, trends, df.where(f"RawFileName = 'A_Sample_000{10 + i}'").withColumn("MS1.TIC", F.lit(float(i))))
        assert_same(trends.read(), metrics.metric_trends(table.read(), CFG))
    assert len(trends.manifests.latest()[1]["parts"]) == 1
    # An upsert that the trends have not seen: the next one computes all.
    part = table.stage(df.where("RawFileName = 'B_Sample_00003'").withColumn("MS1.TIC", F.lit(5.0)))
    table.upsert(part, 1, 0)
    put(table, trends, df.where("RawFileName = 'B_Sample_00004'").withColumn("MS1.TIC", F.lit(6.0)))
    assert_same(trends.read(), metrics.metric_trends(table.read(), CFG))
    assert trends.vacuum(keep=1, grace=0) > 0 and trends.read().count() == table.read().count() * 2


def test_no_trends_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        TrendTable(spark, str(tmp_path / "none"), CFG).read()
