"""Stored trends of projects that changes cover."""

import pytest
from pyspark.sql import functions as F

from runledger.operators import metrics
from runledger.sources import trends as module
from runledger.sources.store import MergedTable
from test_maintain import assert_same, put, stored
from test_metrics import CFG, frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("changed, whole", [(1, 0), (20, 1)])
def test_projects_covered_by_changes_are_stated_whole(spark, tmp_path, changed, whole):
    """Whole projects leave by name, so that readers do not compare their rows one by one."""
    df = frame(spark, 200).unionByName(frame(spark, 50, project="B")).unionByName(
        frame(spark, 40, project="none").withColumn("ProjectID", F.lit(None).cast("string")))
    table, trends = stored(spark, tmp_path, df)
    for project in ("A", "none"):
        names = [f"{project}_Sample_{i:05d}" for i in range(30, 30 + (changed if project == "A" else 5))]
        put(table, trends, df.where(F.col("RawFileName").isin(names)).withColumn("MS1.TIC", F.lit(9.0)))
        assert_same(trends.read(), metrics.metric_trends(table.read(), CFG))
    # All runs of a project move to another.
    put(table, trends, df.where("ProjectID = 'B'").withColumn("ProjectID", F.lit("A")))
    assert_same(trends.read(), metrics.metric_trends(table.read(), CFG))
    first = trends.manifests.latest()[1]["parts"][0]
    assert trends._load(first[3]).count() == whole and trends._load(first[1]).isEmpty() == bool(whole)


def test_trends_are_computed_once(spark, tmp_path, monkeypatch):
    """A layout by ranges has its input sampled, which computes it twice."""
    seen = []
    monkeypatch.setattr(module.TrendTable, "_stage", lambda self, rows: seen.append(plan(rows)) or "x")
    monkeypatch.setattr(module.TrendTable, "_publish", lambda *a: None)
    table = MergedTable(spark, str(tmp_path / "t"), CFG)
    table.replace(frame(spark, 40))
    module.TrendTable(spark, str(tmp_path / "s"), CFG).rebuild(table)
    assert "rangepartitioning" not in seen[0]
