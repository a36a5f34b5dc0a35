import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from runledger import build_session  # noqa: E402
from runledger.plans.fixtures import EVENT_CONFIG, EventSources  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "2000",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cfg():
    return EVENT_CONFIG


@pytest.fixture(scope="session")
def events(spark):
    return EventSources.load(spark, SMALL)


@pytest.fixture(scope="session")
def merged(spark, events, cfg, tmp_path_factory):
    """The merged table of the small data, stored once."""
    from runledger.operators.merge import merge_sources

    path = str(tmp_path_factory.mktemp("merged") / "t")
    merge_sources(events.reports, events.sample_meta, events.project_meta, cfg).write.parquet(path)
    return spark.read.parquet(path)


def rows(df, *cols):
    """Collected rows as sorted tuples."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
