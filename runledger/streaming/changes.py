"""From changed paths to the sources they belong to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT, METADATA, UNKNOWN = "report", "metadata", "unknown"


def registry_frame(spark: SparkSession, registry: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Known paths as a table: path -> (source, role)."""
    return spark.createDataFrame([(p, s, r) for p, (s, r) in registry.items()], "path string, source string, role string")


def route_changes(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """Each changed path once, with its source and role; unknown paths are kept and marked.

    The registry has one row per configured source and is broadcast.
    """
    return (
        paths.groupBy("path").agg(F.count("*").alias("n_events"))
        .join(F.broadcast(registry), "path", "left")
        .select("path", "source", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), "n_events")
    )
