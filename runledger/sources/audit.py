"""The refresh log: when the table was refreshed, from what, and its row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions import format_second, refreshed_text
from runledger.sources import files

AUDIT_SCHEMA = "updated_at timestamp_ntz, source_mtimes string, row_count bigint"
UNAVAILABLE = "unavailable"


def mtimes_json(mtimes: DataFrame) -> DataFrame:
    """One row: a JSON object from source to change time. There is one entry per source."""
    text = F.coalesce(format_second(F.col("mtime")), F.lit(UNAVAILABLE))
    entries = F.sort_array(F.collect_list(F.struct("source", text.alias("at"))))
    return mtimes.agg(F.to_json(F.map_from_entries(entries)).alias("source_mtimes"))


def entry(mtimes: DataFrame) -> dict[str, str]:
    """What a refresh notes beside the row count: its time, and the change times of its sources. One row for any sources."""
    row = mtimes_json(mtimes).select(F.localtimestamp().cast("string").alias("updated_at"), "source_mtimes").first()
    return row.asDict()


class AuditLog:
    """The refreshes since the last full build, which starts the log anew.

    An entry is a part of the manifest that shows the refreshed table, so table and log change together or not at all.
    """

    def __init__(self, spark: SparkSession, root: str, generation: str) -> None:
        self.spark, self.generation = spark, generation
        self.folder = f"{root.rstrip('/')}/manifests"

    def read(self) -> DataFrame:
        if not files.exists(self.spark, self.folder):
            return self.spark.createDataFrame([], AUDIT_SCHEMA)
        manifests = self.spark.read.option("multiLine", True).schema(
            "generation string, rows bigint, audit struct<updated_at: string, source_mtimes: string>").json(f"{self.folder}/*.json")
        own = manifests.where((F.col("generation") == self.generation) & F.col("audit").isNotNull())
        return own.select(F.col("audit.updated_at").cast("timestamp_ntz").alias("updated_at"), "audit.source_mtimes", F.col("rows").alias("row_count"))


def latest_refresh(audit: DataFrame) -> DataFrame:
    """The newest row with the rows gained since the one before; empty without a log."""
    # Only the two newest rows matter, so the window never sees more.
    newest = audit.orderBy(F.col("updated_at").desc(), F.col("row_count").desc()).limit(2)
    in_time = Window.orderBy("updated_at", "row_count")
    gained = (F.col("row_count") - F.lag("row_count").over(in_time)).cast("bigint")
    return (
        newest.withColumn("new_rows", gained)
        .orderBy(F.col("updated_at").desc(), F.col("row_count").desc()).limit(1)
    )


def freshness(audit: DataFrame) -> DataFrame:
    """Time of the last refresh, rows gained, and the text to show."""
    last = latest_refresh(audit)
    return last.select(
        "updated_at", "new_rows", refreshed_text(F.col("updated_at"), F.col("new_rows")).alias("text"))
