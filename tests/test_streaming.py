"""Routing of changes and the refresh stream."""

import datetime as dt

from conftest import rows
from runledger import Ledger, LedgerConfig, Metric
from runledger.sources.databases import LANDED, SourceDatabase
from runledger.streaming import changes, ingest, landing

CFG = LedgerConfig(metrics=(Metric("Metric", "Metric", "A metric"),))


def test_route_changes(spark):
    registry = changes.registry_frame(spark, {"/x/a": ("a", changes.REPORT), "/x/m": ("m", changes.METADATA)})
    paths = spark.createDataFrame([("/x/a",), ("/x/a",), ("/x/m",), ("/x/a2",)], "path string")
    assert rows(changes.route_changes(paths, registry)) == [
        ("/x/a", "a", "report", 2), ("/x/a2", None, "unknown", 1), ("/x/m", "m", "metadata", 1)]


def land(spark, root, source, version, runs):
    df = spark.createDataFrame(runs, "Name string, `System.Time.s` double, Metric double")
    landing.land_version(spark, root, source, version, {"SingleFileReport": df})


def land_meta(spark, root, version, samples):
    landing.land_version(spark, root, "meta", version, {
        "Metadata_Sample": spark.createDataFrame(samples, "SampleName_ID string, ProjectID string, CreationDate string"),
        "Metadata_Project": spark.createDataFrame([("P", "t", "name")], "ProjectID string, TimeRange string, ProjectName string")})


def run(ledger, root, checkpoint):
    q = ingest.start_refresh_stream(ledger, root, checkpoint, available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_stream_of_versions(spark, tmp_path):
    root, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    land(spark, root, "one", 1, [("a_b_c_1", 1.0, 1.0)])
    land(spark, root, "two", 1, [("a_b_c_2", 2.0, 2.0), ("a_b_c_1.raw", 1.0, 9.0)])
    land_meta(spark, root, 1, [("a_b_c_1.raw", "P", "2024-01-01 00:00:00")])
    ledger = Ledger(spark, str(tmp_path / "root"), [SourceDatabase("one", root, LANDED), SourceDatabase("two", root, LANDED)],
                    SourceDatabase("meta", root, LANDED), CFG)
    ledger.validate()

    run(ledger, root, checkpoint)
    assert rows(ledger.merged(), "RawFileName", "ProjectID", "Metric", "Metric_iQC") == [
        ("a_b_c_1", "P", 1.0, 9.0), ("a_b_c_2", "a_b_c", 2.0, None)]
    assert ledger.audit().count() == 1  # three changes, one refresh

    run(ledger, root, checkpoint)  # nothing new
    assert ledger.audit().count() == 1

    land(spark, root, "one", 2, [("a_b_c_1", 1.0, 5.0), ("a_b_c_3", 3.0, 3.0)])
    land(spark, root, "one", 10, [("a_b_c_1", 1.0, 6.0), ("a_b_c_3", 3.0, 3.0)])
    land(spark, root, "stranger", 1, [("x", 1.0, 1.0)])
    run(ledger, root, checkpoint)
    assert rows(ledger.merged(), "RawFileName", "Metric") == [("a_b_c_1", 6.0), ("a_b_c_2", 2.0), ("a_b_c_3", 3.0)]
    assert ledger.audit().count() == 2 and ledger.freshness().first()["new_rows"] == 1

    land(spark, root, "stranger", 2, [("x", 1.0, 1.0)])
    run(ledger, root, checkpoint)
    assert ledger.audit().count() == 2  # unknown sources alone cause no refresh


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "landing")
    land(spark, root, "one", 1, [("a_b_c_1", 1.0, 1.0)])
    land_meta(spark, root, 1, [])
    ledger = Ledger(spark, str(tmp_path / "root"), SourceDatabase("one", root, LANDED), SourceDatabase("meta", root, LANDED), CFG)
    handle = ingest.change_handler(ledger, root)
    batch = spark.createDataFrame([(landing.source_path(spark, root, "one"), dt.datetime(2024, 1, 1))], "path string, modified timestamp")
    handle(batch, 0)
    once = rows(ledger.merged())
    handle(batch, 1)
    assert rows(ledger.merged()) == once


def test_ingest_copies_mutable_sources_first(spark, tmp_path):
    for name, table, schema in (("r", "SingleFileReport", "Name string, `System.Time.s` double, Metric double"),
                                ("meta", "Metadata_Sample", "SampleName_ID string, ProjectID string, CreationDate string"),
                                ("meta", "Metadata_Project", "ProjectID string, TimeRange string")):
        data = [("a_b_c_d", 1.0, 2.0)] if name == "r" else []
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / table))
    ledger = Ledger(spark, str(tmp_path / "root"), SourceDatabase("r", str(tmp_path / "r")), SourceDatabase("meta", str(tmp_path / "meta")), CFG)
    (tmp_path / "landing" / "markers" / "r").mkdir(parents=True)
    q = ingest.ingest(ledger, str(tmp_path / "landing"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(60)
    assert ledger.merged().count() == 1
    assert ledger.working(ledger.reports[0]).tables(spark) == ["SingleFileReport"]


def test_replayed_batch_adds_no_entry_to_the_log(spark, tmp_path):
    root = str(tmp_path / "landing")
    land(spark, root, "one", 1, [("a_b_c_1", 1.0, 1.0)])
    land_meta(spark, root, 1, [])
    ledger = Ledger(spark, str(tmp_path / "root"), SourceDatabase("one", root, LANDED), SourceDatabase("meta", root, LANDED), CFG)
    handle = ingest.change_handler(ledger, root, "stream")
    batch = spark.createDataFrame([(landing.source_path(spark, root, "one"), dt.datetime(2024, 1, 1))], "path string, modified timestamp")
    handle(batch, 0)
    land(spark, root, "one", 2, [("a_b_c_1", 1.0, 2.0)])
    handle(batch, 1)
    before = ledger.table.number, rows(ledger.audit(), "row_count")
    handle(batch, 1)  # the table was shown, but the checkpoint not written
    assert (ledger.table.number, rows(ledger.audit(), "row_count")) == before and len(before[1]) == 2
    # Another stream has steps of its own, and a full build keeps what is done but starts the log anew.
    land(spark, root, "one", 3, [("a_b_c_1", 1.0, 3.0)])
    ingest.change_handler(ledger, root, "other")(batch, 0)
    assert ledger.audit().count() == 3 and ledger.merged().first()["Metric"] == 3.0
    ledger.refresh(full=True)
    assert ledger.audit().count() == 1 and ledger.table.has_done(("stream", 1)) and not ledger.table.has_done(("stream", 2))
