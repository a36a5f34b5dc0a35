"""The registered queries of the subpackage: SQL where there is some, the pipeline against its parts."""

import pytest

from compare import compare, duck
from conftest import SMALL
from runledger.llm.queries import ORACLE, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    got = compare(spark, duck(SMALL), SMALL, QUERIES[name], ORACLE[name])
    assert not got["problem"] and got["rows"] > 0


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in c.STAGES[:-1]:
        after = c.materialised(stage(spark, before, SMALL))
        assert after.columns == columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    packed = c.packing(spark, before, SMALL)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
    assert c.run(spark, SMALL).count() == packed.count()


def test_everything_else_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(__import__("sys").modules, "runledger.llm.queries", None)
    assert "merged" in entry.queries() and "op7_block_names" not in entry.queries()
