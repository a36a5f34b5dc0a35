"""The key index answers many keys without a row for each pair of key and file."""

from pyspark.sql import functions as F

from runledger.sources import keyindex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_makes_no_pairs(spark, tmp_path):
    """Every key meets every file; the join ends at the first that a file may hold."""
    rows = spark.range(4000).select(F.concat(F.lit("run_"), F.col("id")).alias("k"), (F.col("id") % 8).alias("at"))
    rows.repartition(8, "at").write.parquet(str(tmp_path / "part"))
    part = spark.read.parquet(str(tmp_path / "part"))
    index = keyindex.file_index(part, "k", 2)
    # Each row sets its two bits, in the one bitmap of its bucket and file.
    assert index.groupBy("file", "bucket").count().where("count > 1").isEmpty()
    found = keyindex.touched_files(index, part.select("k"), "k", 2)
    assert "LeftSemi" in plan(found)
    assert {r.file for r in found.collect()} == {r.file for r in index.select("file").distinct().collect()}
    for k in ("run_17", "run_3999"):
        held = part.where(F.col("k") == k).select(F.col("_metadata.file_name").alias("f")).first().f
        assert held in {r.file for r in keyindex.touched_files(index, part.where(F.col("k") == k), "k", 2).collect()}
    assert keyindex.touched_files(index, part.select(F.lit(None).cast("string").alias("k")), "k", 2).isEmpty()
