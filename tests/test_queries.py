"""Every registered query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from conftest import SMALL
from runledger.__main__ import parser, source
from runledger.plans.oracle import ORACLE
from runledger.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "metric" in df.columns


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = compare(spark, con, SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert not got["problem"], got["problem"]
    assert got["rows"] > 0


def test_command_line():
    args = parser().parse_args(["report", "--root", "/r", "--report", "a=sqlite:/x/a.sqlite", "--metadata", "m=parquet:hdfs://h/m"])
    assert (args.report[0].name, args.report[0].format, args.report[0].location) == ("a", "sqlite", "/x/a.sqlite")
    assert args.metadata.location == "hdfs://h/m"
    with pytest.raises(SystemExit):
        parser().parse_args(["report", "--root", "/r", "--report", "nonsense", "--metadata", "m=parquet:/m"])
    with pytest.raises(Exception, match="name=format:location"):
        source("a=b")
