"""Source databases: reading, validation, snapshots, change times."""

import sqlite3
from contextlib import closing

import pytest

from conftest import rows
from runledger import LedgerConfig
from runledger.sources import files, sqlite
from runledger.sources.databases import SourceDatabase, read_project_meta, read_sample_meta, source_mtimes, validate_sources
from runledger.sources.snapshot import sync_sources, vacuum_snapshot

CFG = LedgerConfig()


@pytest.fixture
def lab(tmp_path):
    """A SQLite file with odd values."""
    path = tmp_path / "lab.sqlite"
    with closing(sqlite3.connect(path)) as con, con:
        con.execute('CREATE TABLE SingleFileReport ("Name" TEXT, "System.Time.s" REAL, "n" INTEGER, "any")')
        con.executemany("INSERT INTO SingleFileReport VALUES (?, ?, ?, ?)", [
            ("a", 1.5, 1, "x"), ("b", None, None, 2), (None, None, None, None), (7, 3, 4.0, b"raw")])
        con.execute("CREATE TABLE empty (x TEXT)")
        con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        con.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
    return str(path)


def folder(spark, path, *tables):
    for t in tables:
        spark.createDataFrame([(t, "x")], "SampleName_ID string, ProjectID string").write.parquet(f"{path}/{t}")
    return str(path)


def test_sqlite(spark, lab, tmp_path):
    df = sqlite.read_sqlite(spark, lab, "SingleFileReport", rowsPerTask="1")
    assert df.dtypes == [("Name", "string"), ("System.Time.s", "double"), ("n", "bigint"), ("any", "string")]
    assert rows(df) == [(None, None, None, None), ("7", 3.0, 4, "raw"), ("a", 1.5, 1, "x"), ("b", None, None, "2")]
    assert df.rdd.getNumPartitions() == 4
    assert sqlite.read_sqlite(spark, lab, "empty").count() == 0
    assert sqlite.read_sqlite(spark, lab, "keyed").count() == 2
    assert sqlite.read_sqlite(spark, lab, "keyed", columns="v").columns == ["v"]
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, lab, "missing")
    odd = str(tmp_path / "odd.sqlite")
    with closing(sqlite3.connect(odd)) as con, con:
        con.execute("CREATE TABLE odd (i INTEGER, r REAL)")
        con.executemany("INSERT INTO odd VALUES (?, ?)", [(12.7, 1.0), (1, "n/a")])
    for column in ("i", "r"):  # values that the column's type cannot hold are no silent change
        with pytest.raises(Exception, match="declare the column TEXT"):
            sqlite.read_sqlite(spark, odd, "odd", columns=column).collect()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_file_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(str(tmp_path / "db" / "t"))
    source = SourceDatabase("s", str(tmp_path / "db"), fmt, {"header": "true"} if fmt == "csv" else {})
    assert source.tables(spark) == ["t"] and rows(source.read(spark, "t")) == [("a", "1"), ("b", "2")]
    with pytest.raises(ValueError, match="no table"):
        source.read(spark, "u")


def test_single_files_and_catalog(spark, tmp_path):
    assert "events" in SourceDatabase("td", "/root/testdata/sf0.001").tables(spark)
    assert SourceDatabase("td", "/root/testdata/sf0.001").read(spark, "region").count() == 5
    spark.range(3).createOrReplaceTempView("nothing")
    spark.sql("CREATE DATABASE lab_one")
    spark.range(3).write.saveAsTable("lab_one.numbers")
    source = SourceDatabase("c", "lab_one", "catalog")
    assert source.exists(spark) and "numbers" in source.tables(spark) and source.read(spark, "numbers").count() == 3
    assert not SourceDatabase("c", "lab_two", "catalog").exists(spark)
    with pytest.raises(ValueError, match="unknown format"):
        SourceDatabase("x", "y", "xml")


def test_validation(spark, tmp_path, lab):
    validate_sources(spark, CFG)
    report = SourceDatabase("r", lab, "sqlite")
    validate_sources(spark, CFG, report)
    validate_sources(spark, CFG, [report])
    good = SourceDatabase("m", folder(spark, tmp_path / "m", "Metadata_Project", "Metadata_Sample"))
    validate_sources(spark, CFG, [report], good)
    with pytest.raises(FileNotFoundError, match="gone"):
        validate_sources(spark, CFG, [SourceDatabase("r", str(tmp_path / "gone"))])
    half = SourceDatabase("m", folder(spark, tmp_path / "half", "Metadata_Project"))
    with pytest.raises(ValueError, match=r"lacks required tables \['Metadata_Sample'\].*found \['Metadata_Project'\]"):
        validate_sources(spark, CFG, None, half)
    broken = tmp_path / "broken.sqlite"
    broken.write_text("this is no database, just a text that is long enough")
    with pytest.raises(ValueError, match="cannot be read"):
        validate_sources(spark, CFG, SourceDatabase("b", str(broken), "sqlite"))
    assert read_project_meta(spark, good, CFG).first()[0] == "Metadata_Project"
    assert read_sample_meta(spark, good, CFG).first()[0] == "Metadata_Sample"


def test_sync(spark, tmp_path, lab):
    source = SourceDatabase("lab", lab, "sqlite")
    target = str(tmp_path / "copy")
    copy = SourceDatabase("lab", target, "snapshot")
    assert sync_sources(spark, source, target)
    assert copy.tables(spark) == source.tables(spark)
    assert rows(copy.read(spark, "SingleFileReport")) == rows(source.read(spark, "SingleFileReport"))
    with closing(sqlite3.connect(lab)) as con, con:
        con.execute("INSERT INTO empty VALUES ('now')")
    reader = copy.read(spark, "empty")
    assert sync_sources(spark, [source], [target])
    assert copy.read(spark, "empty").count() == 1 and reader.count() == 0  # who read before reads the old state
    assert sync_sources(spark, source, target) and copy.version(spark) == "2"  # nothing has changed, nothing is written
    assert vacuum_snapshot(spark, target, keep=1) == 0 and vacuum_snapshot(spark, target, keep=1, grace=0) == 3 and copy.read(spark, "empty").count() == 1


def test_sync_that_cannot_be_complete(spark, tmp_path, lab):
    good, gone = SourceDatabase("lab", lab, "sqlite"), SourceDatabase("gone", str(tmp_path / "gone"))
    targets = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert not sync_sources(spark, None, targets)
    assert not sync_sources(spark, [good], None)
    assert not sync_sources(spark, [good], targets)
    assert not files.exists(spark, targets[0])
    assert not sync_sources(spark, [gone, good], targets)
    assert SourceDatabase("b", targets[1], "snapshot").tables(spark) == ["SingleFileReport", "empty", "keyed"]


def test_change_times(spark, tmp_path, lab):
    sources = [SourceDatabase("lab", lab, "sqlite"), SourceDatabase("gone", str(tmp_path / "gone")),
               SourceDatabase("dir", folder(spark, tmp_path / "d", "t"))]
    got = {r["source"]: r["mtime"] for r in source_mtimes(spark, sources).collect()}
    assert got["lab"] is not None and got["dir"] is not None and got["gone"] is None


def test_outcomes_name_every_table(spark, tmp_path):
    from runledger.sources.databases import Outcome, validation_outcomes

    spark.range(3).write.parquet(str(tmp_path / "a" / "SingleFileReport"))
    spark.range(2).write.parquet(str(tmp_path / "meta" / "Metadata_Sample"))
    a, meta, gone = (SourceDatabase(n, str(tmp_path / n)) for n in ("a", "meta", "gone"))
    cfg = LedgerConfig()
    got = {(r.source, r.table): (r.state, r.n_rows, r.error is None) for r in validation_outcomes(spark, cfg, [a, gone], meta).collect()}
    assert got == {("a", "SingleFileReport"): ("ok", 3, True), ("gone", "SingleFileReport"): ("absent", None, False),
                   ("meta", "Metadata_Project"): ("missing", None, False), ("meta", "Metadata_Sample"): ("ok", 2, False)}
    assert validation_outcomes(spark, cfg, [gone]).first().state == "absent" and validation_outcomes(spark, cfg, []).isEmpty()
    assert isinstance(Outcome.of(spark, gone, ("x",)).error, FileNotFoundError) and Outcome.of(spark, a, ("SingleFileReport",)).error is None
