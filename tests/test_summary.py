"""Stored project summaries against those computed from the table."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runledger.operators import projects
from runledger.plans.refresh import upsert_with_trends
from runledger.sources import summary as module
from runledger.sources.store import MergedTable
from runledger.sources.summary import SummaryTable
from test_metrics import CFG, frame


def put(table, summary, given):
    part = table.stage(given)
    stored = table.staged(part)
    n = stored.count()
    known = table.rows_of(stored.select("RawFileName"), n).count()
    upsert_with_trends(table, part, n, n - known, summary=summary)


def check(table, summary):
    assert rows(summary.read()) == rows(projects.project_overview(table.read(), CFG))
    assert [r.ProjectID for r in summary.start_page(3).collect()] == [r.ProjectID for r in projects.project_page(table.read(), 3).collect()]


def test_changes_of_every_kind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MAX_PARTS", 4)
    df = frame(spark, 40).unionByName(frame(spark, 6, project="B")).unionByName(frame(spark, 3, "2023-05-01", project="C"))
    df = df.unionByName(frame(spark, 2, project="none").withColumn("ProjectID", F.lit(None).cast("string")))
    table, summary = MergedTable(spark, str(tmp_path / "t"), CFG), SummaryTable(spark, str(tmp_path / "s"), CFG)
    with pytest.raises(FileNotFoundError):
        summary.read()
    table.replace(df)
    summary.rebuild(table)
    check(table, summary)
    seen = []
    real = SummaryTable.follow
    monkeypatch.setattr(SummaryTable, "follow", lambda self, *a: seen.append(real(self, *a)))
    at = lambda name: df.where(F.col("RawFileName") == name)
    time = lambda d, t: d.withColumn("DateTime", F.lit(t).cast("timestamp_ntz"))
    for given, again in (
        (at("A_Sample_00003").withColumn("Error", F.lit("lost")), 0),  # no maximum is touched
        (time(at("A_Sample_00039"), "2020-01-01 00:00:00"), 1),  # the newest run is taken away
        (time(at("B_Sample_00005"), "2024-02-02 00:00:00"), 0),  # and here replaced by a newer one
        (time(at("C_Sample_00001"), None), 0),  # a run without a time is the last one
        (at("C_Sample_00001"), 1),  # and no longer
        (at("B_Sample_00005").withColumn("ProjectID", F.lit("A")), 1),  # moves to another project
        (frame(spark, 2, project="N"), 0),
        (df.where("ProjectID = 'C'").withColumn("ProjectID", F.lit("D")), 0),  # a project without runs goes
        (time(at("none_Sample_00001"), "2020-01-01 00:00:00"), 1),
        (df.limit(0), 0),
    ):
        put(table, summary, given)
        check(table, summary)
        assert seen[-1] == again
    assert "C" not in {r.ProjectID for r in summary.read().collect()}
    assert all("/s/parts/" in f for f in summary.read().inputFiles()) and all("/s/parts/" in f for f in summary.start_page().inputFiles())
    # A state that was not seen: all are computed.
    part = table.stage(at("A_Sample_00007").withColumn("Error", F.lit("lost")))
    table.upsert(part, 1, 0)
    put(table, summary, at("A_Sample_00008").withColumn("Error", F.lit("lost")))
    assert seen[-1] == -1
    check(table, summary)
    assert summary.vacuum(keep=1, grace=0) > 0
    check(table, summary)
