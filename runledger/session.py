"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, least: int = 200) -> int:
    """Shuffle partitions for an input of this size: about 128 MB each."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app_name: str = "runledger", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` entries win.

    ``input_bytes`` sizes the shuffles. Too high a number does no harm, as adaptive
    execution merges small partitions; too low a number cannot be mended later.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Spark broadcasts a side on its own only when its measured size is below this.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.sql.parquet.filterPushdown": "true",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
        # Leaves out call sites in error messages; plans are built faster without them.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    if input_bytes is not None:
        settings.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions_for(input_bytes)))
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the checkpoint folder the cluster names.

    Only a local master may fall back to a folder of this machine: executors of a
    cluster could not read it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="runledger-checkpoint-")
    sc.setCheckpointDir(folder)


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def materialised(df: DataFrame) -> DataFrame:
    """Write a result that several steps read to the shared checkpoint folder.

    As a columnar table it is computed once and read by column, and its lineage
    ends there: losing an executor later recomputes nothing before it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was materialised within."""
    from runledger.sources.files import remove_tree

    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            remove_tree(spark, path)
