"""Full and incremental refresh of the stored table, the refresh log, and recent samples."""

import datetime as dt
import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runledger import Ledger, LedgerConfig, Metric
from runledger.operators import recent, upsert
from runledger.operators.checks import DuplicateKeyError
from runledger.plans.refresh import Inputs, full_refresh, incremental_refresh, audit_log
from runledger.sources import audit
from runledger.sources.databases import SourceDatabase
from runledger.sources.files import ConcurrentWriteError, Manifests
from runledger.sources.store import MAX_PARTS, MergedTable

CFG = LedgerConfig(metrics=(Metric("Metric", "Metric", "A metric"),))
REPORT = "Name string, `System.Time.s` double, Metric string"
SAMPLE = "SampleName_ID string, ProjectID string, CreationDate string, Error string"
PROJECT = "ProjectID string, TimeRange string, ProjectName string"


def inputs(spark, runs, samples=(), projects=(("A", "2024", "name"),)):
    return Inputs([spark.createDataFrame(list(runs), REPORT)], spark.createDataFrame(list(samples), SAMPLE),
                  spark.createDataFrame(list(projects), PROJECT))


def mtimes(spark):
    return spark.createDataFrame([("r", dt.datetime(2024, 1, 1)), ("m", None)], "source string, mtime timestamp_ntz")


def runs(n):
    return [(f"P_a_1_{i:03d}", 1000.0 + i, str(i)) for i in range(n)]


def table(spark, tmp_path, cfg=CFG):
    return MergedTable(spark, str(tmp_path / "merged"), cfg)


def test_full_refresh(spark, tmp_path):
    t = table(spark, tmp_path)
    assert not t.exists()
    with pytest.raises(FileNotFoundError):
        t.read()
    data = inputs(spark, runs(10))
    assert full_refresh(t, data, mtimes(spark)).rows_final == 10
    assert full_refresh(t, data, mtimes(spark)).rows_before == 10
    assert t.read().count() == t.row_count() == 10
    assert t.schema() == t.read().schema
    log = audit_log(t).read().collect()
    assert len(log) == 1 and log[0]["row_count"] == 10  # a full build starts the log anew
    assert log[0]["source_mtimes"] == '{"m":"unavailable","r":"2024-01-01 00:00:00"}'
    assert audit.freshness(audit_log(t).read()).first()["new_rows"] is None


def test_failed_build_leaves_the_table(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(3)), mtimes(spark))
    twins = [("x.raw", "A", None, None), ("x.d", "A", None, None)]
    with pytest.raises(DuplicateKeyError):
        full_refresh(t, inputs(spark, runs(5), twins), mtimes(spark))
    assert t.read().count() == 3 and audit_log(t).read().count() == 1


def test_upsert_changes_only_the_edited_row(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(20)), mtimes(spark))
    before = rows(t.read())
    edited = [(n, s, "99999" if n.endswith("007") else m) for n, s, m in runs(20)]
    got = incremental_refresh(t, inputs(spark, edited), mtimes(spark))
    assert (got.rows_before, got.rows_updated, got.rows_inserted, got.rows_final, got.samples) == (20, 20, 0, 20, 20)
    after = rows(t.read())
    changed = [(a, b) for a, b in zip(before, after) if a != b]
    assert len(changed) == 1 and "99999" in changed[0][1]
    assert incremental_refresh(t, inputs(spark, edited), mtimes(spark)).rows_final == 20
    assert rows(t.read()) == after  # twice is once


def test_upsert_inserts_keeps_lost_rows_and_logs_the_gain(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(5)), mtimes(spark))
    got = incremental_refresh(t, inputs(spark, runs(8)[2:]), mtimes(spark))
    assert (got.rows_updated, got.rows_inserted) == (3, 3)
    assert t.read().count() == 8
    last = audit.freshness(audit_log(t).read()).first()
    assert last["new_rows"] == 3 and last["text"].endswith("· +3 samples")


def test_a_look_back_is_a_minimum(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(10)), mtimes(spark))
    zeroed = [(n, s, "0") for n, s, _ in runs(10)]
    changed = spark.createDataFrame([("P_a_1_002",)], "sample_id string")
    got = incremental_refresh(t, inputs(spark, zeroed), mtimes(spark), n=4, changed=changed)
    assert got.samples == 5
    # Run 000 had 0 before.
    assert [r[0][-3:] for r in rows(t.read().where("Metric = '0'"), "RawFileName")] == ["000", "002", "006", "007", "008", "009"]
    # Unless the caller knows better, every row may have changed.
    incremental_refresh(t, inputs(spark, zeroed), mtimes(spark), n=4)
    assert t.read().where("Metric = '0'").count() == 10


def landed(spark, landing, version, reports, samples=(), projects=(("P_a_1", "2024", "name"),)):
    from runledger.streaming.landing import land_version

    data = inputs(spark, reports, samples, projects)
    land_version(spark, landing, "r", version, {"SingleFileReport": data.reports[0]})
    land_version(spark, landing, "m", version, {"Metadata_Sample": data.samples, "Metadata_Project": data.projects})


def test_a_refresh_takes_every_change(spark, tmp_path):
    landing = str(tmp_path / "landing")
    ledger = Ledger(spark, str(tmp_path / "root"), SourceDatabase("r", landing, "landed"), SourceDatabase("m", landing, "landed"), CFG)
    assert ledger.freshness().count() == ledger.audit().count() == 0  # before the first build
    many = runs(900)
    landed(spark, landing, 1, many, [("P_a_1_003.raw", "P_a_1", "2024-01-01 00:00:00", None)])
    ledger.bootstrap()
    # The oldest rows change, far more than any look-back; two rows swap null and value; one sample and the project change.
    edited = [(n, s, "-1") for n, s, _ in many[:700]] + many[700:]
    landed(spark, landing, 2, edited, [("P_a_1_003.raw", "P_a_1", None, "bad")], (("P_a_1", "2024", "renamed"),))
    got = ledger.refresh()
    assert (got.rows_updated, got.rows_inserted, got.samples) == (900, 0, 900)  # all, as their project has a new name
    assert ledger.merged().where("Metric = '-1'").count() == 700
    assert ledger.merged().where("ProjectName = 'renamed'").count() == 900
    assert rows(ledger.merged().where("Error = 'bad'"), "RawFileName") == [("P_a_1_003",)]
    assert ledger.refresh() is None  # nothing has changed since
    # A source that lands while a refresh runs is read at the version looked up first.
    landed(spark, landing, 3, edited[:-1] + [("P_a_1_899", 7.0, "5")], [("P_a_1_003.raw", "P_a_1", None, "bad")], (("P_a_1", "2024", "renamed"),))
    pinned = Inputs.load(spark, ledger.reports, ledger.metadata, CFG)
    landed(spark, landing, 4, [], [])
    assert pinned.reports[0].count() == 900 and pinned.samples.count() == 1 and set(pinned.versions.values()) == {"3"}


def test_one_changed_row_is_one_sample(spark, tmp_path):
    landing = str(tmp_path / "landing")
    ledger = Ledger(spark, str(tmp_path / "root"), SourceDatabase("r", landing, "landed"), SourceDatabase("m", landing, "landed"), CFG)
    landed(spark, landing, 1, runs(30))
    ledger.bootstrap()
    landed(spark, landing, 2, [(n, s, None if n.endswith("004") else m) for n, s, m in runs(30)] + [("P_a_1_500.raw", 3.0, "1")])
    got = ledger.refresh()
    assert (got.samples, got.rows_updated, got.rows_inserted) == (2, 1, 1)


def test_vacuum_leaves_a_running_refresh_alone(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(3)), mtimes(spark))
    part = t.stage(t.read().limit(1))
    assert t.vacuum() == 0  # it is young
    assert t.upsert(part, 1, 0) == 3 and t.read().count() == 3
    part = t.stage(t.read().limit(1))
    assert t.vacuum(grace=0) == 1
    with pytest.raises(FileNotFoundError, match="removed"):
        t.upsert(part, 1, 0)
    assert t.read().count() == 3


def test_empty_sources_change_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(2)), mtimes(spark))
    assert incremental_refresh(t, inputs(spark, []), mtimes(spark)) is None
    assert audit_log(t).read().count() == 1


def test_new_columns_are_ignored_and_lost_ones_an_error(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(2)), mtimes(spark))
    data = inputs(spark, runs(3))
    more = Inputs(data.reports, data.samples.withColumn("Extra", F.lit("x")), data.projects)
    incremental_refresh(t, more, mtimes(spark))
    assert "Extra" not in t.read().columns and t.read().count() == 3
    less = Inputs(data.reports, data.samples, data.projects.drop("ProjectName"))
    with pytest.raises(ValueError, match="ProjectName"):
        incremental_refresh(t, less, mtimes(spark))


def test_updates_take_the_types_of_the_table(spark, tmp_path):
    t = table(spark, tmp_path)
    numbers = lambda data: Inputs([data.reports[0].withColumn("Metric", F.col("Metric").cast("double"))], data.samples, data.projects)
    full_refresh(t, numbers(inputs(spark, runs(2))), mtimes(spark))
    incremental_refresh(t, inputs(spark, [("P_a_1_001", 1.0, "99999")]), mtimes(spark))
    assert dict(rows(t.read(), "RawFileName", "Metric")) == {"P_a_1_000": 0.0, "P_a_1_001": 99999.0}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        incremental_refresh(t, inputs(spark, [("P_a_1_001", 1.0, "n/a")]), mtimes(spark))
    assert t.read().count() == 2


def test_duplicate_samples_collapse_in_an_upsert(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(2)), mtimes(spark))
    twins = [("x.raw", "A", "2024-01-01 00:00:00", None), ("x.d", "A", "2024-01-02 00:00:00", None), (None, "A", None, None)]
    incremental_refresh(t, inputs(spark, runs(2), twins), mtimes(spark))
    assert rows(t.read().where("RawFileName = 'x'"), "SampleName_ID") == [("x.d",)]
    assert t.read().count() == 3


def test_rows_without_a_file_name_survive_upserts(spark, tmp_path):
    t = table(spark, tmp_path)
    full_refresh(t, inputs(spark, runs(1), [(None, "A", None, None)] * 2), mtimes(spark))
    incremental_refresh(t, inputs(spark, runs(2), [(None, "A", None, None)]), mtimes(spark))
    assert t.read().where("RawFileName IS NULL").count() == 2 and t.read().count() == 4


def test_incremental_over_an_empty_table_equals_a_full_build(spark, tmp_path, events, cfg):
    data = Inputs(events.reports, events.sample_meta, events.project_meta)
    full = MergedTable(spark, str(tmp_path / "full"), cfg)
    full_refresh(full, data, mtimes(spark))
    empty = Inputs([r.limit(0) for r in events.reports], events.sample_meta.limit(0), events.project_meta)
    step = MergedTable(spark, str(tmp_path / "step"), cfg)
    full_refresh(step, empty, mtimes(spark))
    incremental_refresh(step, data, mtimes(spark), n=5000)
    assert rows(step.read()) == rows(full.read())


def test_many_upserts_are_compacted(spark, tmp_path):
    cfg = CFG.with_(compact_rows=12)
    t = table(spark, tmp_path, cfg)
    full_refresh(t, inputs(spark, runs(3)), mtimes(spark))
    first_base = t._state()[1]["base"]
    expected = {f"P_a_1_{i:03d}": str(i) for i in range(3)}
    for step in range(MAX_PARTS + 3):
        name = f"P_a_1_{step % 20:03d}"
        expected[name] = f"v{step}"
        part = t.stage(t.read().limit(1).withColumns({"RawFileName": F.lit(name), "Metric": F.lit(f"v{step}")}))
        t.upsert(part, 1, 0 if step < 3 else 1)
        assert len(t._state()[1]["parts"]) < MAX_PARTS
    assert dict(rows(t.read(), "RawFileName", "Metric")) == expected
    assert t._state()[1]["base"] != first_base and t.row_count() == t.read().count() == len(expected)
    generation = t.generation
    assert t.vacuum(grace=0) > 0
    assert dict(rows(t.read(), "RawFileName", "Metric")) == expected and t.generation == generation


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "m"))
    assert m.latest() is None
    assert m.publish(0, {"a": 1}) == 1
    with pytest.raises(ConcurrentWriteError):
        m.publish(0, {"a": 2})
    assert m.latest() == (1, {"a": 1})


def test_recent_samples(spark):
    report = spark.createDataFrame([("a.raw", 3.0), ("b", None), ("c", 9.0), ("a", 5.0)], "Name string, `System.Time.s` double")
    meta = spark.createDataFrame([("m.raw", "1970-01-01 00:00:07"), ("m.d", "1970-01-01 00:00:07"), ("z", None)],
                                 "SampleName_ID string, CreationDate string")
    at = lambda s: dt.datetime(1970, 1, 1, 0, 0, s)
    assert rows(recent.recent_samples_meta(meta, 2, CFG)) == [("m", at(7)), ("z", None)]  # copies among the newest
    assert rows(recent.recent_samples_meta(meta, 2, CFG.with_(broadcast_rows=0))) == [("m", at(7)), ("z", None)]
    assert rows(recent.recent_samples_meta(meta, 9, CFG)) == [("m", at(7)), ("z", None)]  # fewer than asked for
    assert rows(recent.recent_samples_meta(meta, 1, CFG)) == [("m", at(7))]
    assert recent.recent_samples_meta(meta.limit(0), 5, CFG).count() == 0
    assert rows(recent.recent_samples([report], meta, 2, CFG)) == [("a", at(5)), ("c", at(9)), ("m", at(7)), ("z", None)]


def test_recents_cut_inputs_as_they_cut_the_output(spark, events, cfg):
    rec = recent.recent_samples(events.reports, events.sample_meta, 60, cfg)
    cut = upsert.recent_merge(events.reports, events.sample_meta, events.project_meta, rec, 180, cfg)
    from runledger.operators.merge import merge_sources

    whole = merge_sources(events.reports, events.sample_meta, events.project_meta, cfg)
    assert rows(cut) == rows(upsert.recent_semi(whole, rec.distinct()))


def test_ledger_over_sqlite(spark, tmp_path):
    report, meta = tmp_path / "report.sqlite", tmp_path / "meta.sqlite"
    with closing(sqlite3.connect(report)) as con, con:
        con.execute('CREATE TABLE SingleFileReport ("Name" TEXT, "System.Time.s" REAL, "Metric" REAL)')
        con.executemany("INSERT INTO SingleFileReport VALUES (?, ?, ?)", [
            ("Proj_A_01_S1", 1755439995, 1000), ("Proj_A_01_S1.raw", 1755439995, 2000), ("Proj_A_01_S1", 1755439995, 1000),
            ("Proj_A_01_S2.raw", 1755442365, 2500), ("Proj_A_01_S3", 1755439900, 3000)])
    with closing(sqlite3.connect(meta)) as con, con:
        con.execute("CREATE TABLE Metadata_Sample (SampleName_ID TEXT, ProjectID TEXT, CreationDate TEXT)")
        con.execute("CREATE TABLE Metadata_Project (ProjectID TEXT, TimeRange TEXT, ProjectName TEXT)")
    ledger = Ledger(spark, str(tmp_path / "root"), SourceDatabase("r1", str(report), "sqlite"),
                    SourceDatabase("meta", str(meta), "sqlite"), CFG)
    assert ledger.bootstrap().rows_final == 3
    assert rows(ledger.merged(), "RawFileName", "Metric", "Metric_iQC") == [
        ("Proj_A_01_S1", 1000.0, 2000.0), ("Proj_A_01_S2", None, 2500.0), ("Proj_A_01_S3", 3000.0, None)]
    with closing(sqlite3.connect(report)) as con, con:
        con.execute("UPDATE SingleFileReport SET Metric = 7 WHERE Name = 'Proj_A_01_S3'")
        con.execute("INSERT INTO SingleFileReport VALUES ('Proj_B_02_S1', 1755449900, 5)")
    assert ledger.refresh() is None  # the copy has not moved yet
    assert ledger.sync()
    got = ledger.refresh()
    assert (got.rows_inserted, got.rows_final) == (1, 4)
    assert dict(rows(ledger.merged(), "RawFileName", "Metric"))["Proj_A_01_S3"] == 7.0
    assert [r[0] for r in ledger.projects().collect()] == ["Proj_B_02", "Proj_A_01"]
    assert [r[0] for r in ledger.projects("b_").collect()] == ["Proj_B_02"]
    assert ledger.freshness().first()["new_rows"] == 1 and ledger.audit().count() == 2
    assert ledger.summary().count() == 2 and ledger.trends().count() == 3
    assert ledger.project("Proj_A_01").count() == 3 and ledger.errors().count() == 0
    assert '"meta":"2' in ledger.audit().first()["source_mtimes"]
