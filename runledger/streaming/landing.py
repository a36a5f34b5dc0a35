"""The landing folder: sources arrive as immutable versions.

Spark's file stream sees new files, not edits, so each change of a source lands
as a new version and is announced by a marker file once it is complete::

    <landing>/data/<source>/<version>/<table>/*.parquet
    <landing>/markers/<source>/<version>

A marker takes the place of a quiet period: half-written versions are never seen.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from runledger.sources import files


def land_version(spark: SparkSession, landing: str, source: str, version: int, tables: Mapping[str, DataFrame]) -> None:
    """Write a version of a source and announce it."""
    root = landing.rstrip("/")
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/data/{source}/{version}/{table}")
    files.write_text(spark, f"{root}/markers/{source}/{version}", ",".join(sorted(tables)))


def source_path(spark: SparkSession, landing: str, source: str) -> str:
    """The path by which a source is known in change events, with scheme and host as listings give it."""
    return files.qualified(spark, f"{landing.rstrip('/')}/markers/{source}")
