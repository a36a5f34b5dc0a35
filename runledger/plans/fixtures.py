"""Report and metadata tables derived from the ``events`` table.

Each event becomes an instrument run. The rules plant what the merge has to cope
with: control twins, copies in two sources, missing clocks and ids, standards,
failed runs. ``FIXTURES.md`` gives the recipe; ``plans/oracle.py`` has the same in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.config import LedgerConfig, Metric
from runledger.functions import format_second

# Given with the read, so that no job has to look it up.
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

EVENT_CONFIG = LedgerConfig(
    metrics=(
        Metric("m1", "m.1", "Metric one", "m1-graph"),
        Metric("m1_iQC", "m.1", "Metric one control", "m1iQC-graph"),
        Metric("m2", "m2", "Metric two", "m2-graph"),
        Metric("m2_iQC", "m2", "Metric two control", "m2iQC-graph"),
    ),
)


def _prefix() -> Column:
    i = F.col("event_id")
    return (
        F.when(i < 4, F.lit("R0_x_B0")).when(i < 24, F.lit("R1_x_B0"))
        .otherwise(F.concat(F.lit("P"), (F.col("user_id") % 12).cast("string"), F.lit("_"), F.col("event_type"),
                            F.lit("_B"), (F.col("user_id") % 3).cast("string")))
    )


def _name() -> Column:
    i = F.col("event_id")
    kind = (
        F.when(i % 23 == 0, F.lit("HSstd")).when(i % 29 == 0, F.lit("Standard"))
        .when(i % 31 == 0, F.lit("[Ss]tandar[dt]")).otherwise(F.concat(F.lit("S"), (i % 4).cast("string")))
    )
    return F.concat_ws("_", _prefix(), kind, i.cast("string"))


@dataclass(frozen=True)
class EventSources:
    """The four source tables over one ``events`` table."""

    events: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> "EventSources":
        return cls(spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet"))

    @cached_property
    def named(self) -> DataFrame:
        origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        epoch = F.timestamp_diff("MICROSECOND", origin, F.col("ts")) / F.lit(1e6)
        return self.events.withColumns({
            "nm": _name(), "pfx": _prefix(), "ep": F.when(F.col("event_id") % 53 != 0, epoch)})

    @cached_property
    def report_a(self) -> DataFrame:
        i = F.col("event_id")
        cols = ["Name", "`System.Time.s`", "`m.1`", "m2"]
        regular = self.named.where(i % 10 != 7).select(
            F.col("nm").alias("Name"), F.col("ep").alias("System.Time.s"), F.col("value").alias("m.1"),
            F.when(i % 17 == 0, F.lit("n/a")).otherwise((i * 2).cast("string")).alias("m2"))
        suffix = F.when(i % 2 == 0, F.lit(".raw")).otherwise(F.lit(".d"))
        control = self.named.where((i % 10).isin(3, 7) & (i % 3 != 0)).select(
            F.concat("nm", suffix).alias("Name"), F.col("ep").alias("System.Time.s"),
            (F.col("value") + 1000).alias("m.1"), (i * 3).cast("string").alias("m2"))
        return regular.unionByName(control).select(*cols)

    @cached_property
    def report_b(self) -> DataFrame:
        return self.named.where((F.col("event_id") % 10).isin(0, 1)).select(
            F.col("nm").alias("Name"), F.col("ep").alias("System.Time.s"), F.col("value").alias("m.1"))

    @property
    def reports(self) -> list[DataFrame]:
        return [self.report_a, self.report_b]

    @cached_property
    def sample_meta(self) -> DataFrame:
        i, user = F.col("event_id"), F.col("user_id")
        return self.named.where(i % 5 != 4).select(
            F.concat("nm", F.lit(".raw")).alias("SampleName_ID"),
            F.when(i % 11 != 0, F.col("pfx")).alias("ProjectID"),
            F.when(i % 41 == 0, F.lit("1970-01-01 00:00:00"))
            .otherwise(format_second(F.col("ts"))).alias("CreationDate"),
            F.when(i % 37 == 0, F.lit("corrupt")).alias("Error"),
            F.concat(F.lit("MS"), (user % 2).cast("string")).alias("MSInstrument"),
            F.when(i % 13 != 0, F.concat(F.lit("LC"), (user % 3).cast("string"))).alias("HPLCInstrument"),
            F.concat(F.lit("C:\\methods\\grad_"), F.col("event_type"), F.lit(".meth")).alias("InstrumentMethod_print"))

    @cached_property
    def project_meta(self) -> DataFrame:
        return (
            self.sample_meta.where(F.col("ProjectID").like("P%")).select("ProjectID").distinct()
            .select("ProjectID", F.lit("2024").alias("TimeRange"),
                    F.concat(F.lit("name of "), F.col("ProjectID")).alias("ProjectName")))
