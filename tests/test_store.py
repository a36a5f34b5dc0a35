"""The merged table on disk: exclusive manifests, key index, compaction of touched files."""

import threading

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runledger.config import LedgerConfig
from runledger.sources import files, keyindex
from runledger.sources.store import MergedTable

CFG = LedgerConfig(metrics=(), compact_rows=1)


def test_one_of_two_writers_wins_every_round(spark, tmp_path):
    m = files.Manifests(spark, str(tmp_path / "m"))
    for number in range(200):
        barrier, told = threading.Barrier(2), []

        def write(who):
            barrier.wait()
            try:
                m.publish(number, {"who": who})
                told.append(who)
            except files.ConcurrentWriteError:
                pass

        threads = [threading.Thread(target=write, args=(i,)) for i in range(2)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(told) == 1 and m.latest() == (number + 1, {"who": told[0]})
    assert not [p for p in (tmp_path / "m" / "manifests").iterdir() if p.name.startswith(".0") and not p.name.endswith(".crc")]


def table_of(spark, path, n=4000, n_files=50):
    df = spark.range(n).select(
        F.format_string("P%02d_x_y_%05d", F.floor(F.col("id") / 100), F.col("id")).alias("RawFileName"), F.format_string("P%02d_x_y", F.floor(F.col("id") / 100)).alias("ProjectID"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("DateTime"), F.lit(0).alias("v"))
    t = MergedTable(spark, str(path), CFG)
    t.replace(df, n_files=n_files)
    return t


def opened(df):
    return {r[0] for r in df.select("_metadata.file_name").distinct().collect()}


def test_clustered_keys_touch_few_files(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    keys = t.read().where("ProjectID = 'P07_x_y'").select("RawFileName").limit(40)  # 1 % of the keys
    some, total = t.touched_files(keys)
    assert total >= 30 and 0 < len(some) < 0.1 * total
    named = t._load(*t._state()[1]["base"]).select("RawFileName", F.col("_metadata.file_name").alias("file"))
    held = {r.file for r in named.join(keys, "RawFileName", "left_semi").collect()}
    assert held <= set(some)
    # Keys within the range of every file, but in none, are kept out by the bits.
    strange = spark.range(50).select(F.format_string("P07_x_y_007%02dz", "id").alias("RawFileName"))
    assert len(t.touched_files(strange)[0]) <= 3
    assert t.touched_files(strange.limit(0))[0] == []
    assert t.touched_files(spark.createDataFrame([(None,)], "RawFileName string"))[0] == []


def test_compaction_leaves_other_files_alone(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    expected = dict(rows(t.read(), "RawFileName", "v"))
    first = t._state()[1]["base"]
    before = {f for p in first for f in files.children(spark, f"{t.root}/{p}")}
    for step, project in enumerate(["P07_x_y", "P23_x_y", "P07_x_y"], 1):
        part = t.stage(t.read().where(f"ProjectID = '{project}'").withColumn("v", F.lit(step)))
        given = t.staged(part)
        n = given.count()
        known = t.holding(given.select("RawFileName")).join(given.select("RawFileName"), "RawFileName", "left_semi").count()
        assert known == n == 100
        assert t.upsert(part, n, 0) == 4000
        expected |= {r[0]: step for r in given.select("RawFileName").collect()}
        state = t._state()[1]
        assert state["base"][: len(first)] == first and state["parts"] == [] and state["pending"] == 0
        assert len(set(state["gone"]) & before) <= 8
        assert dict(rows(t.read(), "RawFileName", "v")) == expected
    # The read opens no file that is gone.
    state = t._state()[1]
    assert not set(state["gone"]) & opened(t._load(*state["base"]).where(~F.col("_metadata.file_name").isin(state["gone"])))
    assert t.vacuum(keep=1, grace=0) > 0 and dict(rows(t.read(), "RawFileName", "v")) == expected


def test_many_touched_files_rewrite_the_base(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    new = t.read().where("substring(RawFileName, -1) IN ('1', '7')").withColumn("v", F.lit(9))
    new = new.unionByName(new.limit(1).withColumn("RawFileName", F.lit("another")))
    part = t.stage(new)
    assert t.upsert(part, t.staged(part).count(), 1) == 4001
    state = t._state()[1]
    assert len(state["base"]) == 1 and state["gone"] == [] and list(state["index"]) == state["base"]
    got = dict(rows(t.read(), "RawFileName", "v"))
    assert len(got) == 4001 and sum(v == 9 for v in got.values()) == 801


def test_rows_without_a_file_name_stay(spark, tmp_path):
    t = MergedTable(spark, str(tmp_path / "t"), CFG)
    schema = "RawFileName string, ProjectID string, DateTime timestamp_ntz, v int"
    t.replace(spark.createDataFrame([(None, None, None, 1), (None, "A", None, 2), ("a", "A", None, 3)], schema), n_files=2)
    part = t.stage(spark.createDataFrame([("a", "A", None, 4), (None, "A", None, 5)], schema))
    t.upsert(part, 2, 1)
    assert rows(t.read(), "RawFileName", "v") == [(None, 1), (None, 2), (None, 5), ("a", 4)]


def test_manifests_without_an_index_can_be_read(spark, tmp_path):
    t = table_of(spark, tmp_path / "t", 200, 2)
    number, state = t._state()
    old = {k: v for k, v in state.items() if k not in ("gone", "index")} | {"base": state["base"][0]}
    t.manifests.publish(number, old)
    assert t.read().count() == 200
    part = t.stage(t.read().limit(5).withColumn("v", F.lit(3)))
    assert t.holding(t.staged(part).select("RawFileName")).count() == 200
    t.upsert(part, 5, 0)
    assert t.read().where("v = 3").count() == 5 and t._state()[1]["index"]


@pytest.mark.parametrize(("n", "files_", "buckets"), [(0, 0, 1), (4096, 1, 1), (4097, 1, 2), (10**6, 1, 256), (10**6, 1000, 1)])
def test_buckets(n, files_, buckets):
    assert keyindex.buckets_for(n, files_) == buckets
