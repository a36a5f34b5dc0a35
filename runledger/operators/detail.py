"""Detail values of projects, for the table above the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import base_name, clean_text, quoted
from runledger.operators.merge import PROJECT_ID, RAW_FILE
from runledger.operators.projects import split_valid_error

# Columns that hold a method path, and the heading they get.
METHOD_COLUMNS = ("InstrumentMethod_print", "InstrumentMethod", "Method")
METHOD_HEADING = "InstrumentMethod"
COLUMN = "column"


def project_detail(merged: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """The distinct values of each detail column over the valid runs of a project.

    One row per value, with the run it was first seen at; ordering by
    ``first_no_time, first_time, first_file`` gives the order of first sight.
    """
    cols = [c for c in cfg.detail_columns if c in merged.columns]
    valid, _ = split_valid_error(merged)
    entries = []
    for i, c in enumerate(cols):
        text = clean_text(F.col(quoted(c)))
        method = c in METHOD_COLUMNS
        if method:
            text = F.when(F.col(quoted(c)).isNull(), text).otherwise(base_name(text))
        entries.append(F.struct(
            F.lit(METHOD_HEADING if method else c).alias(COLUMN), F.lit(i).alias("column_ord"), text.alias("value")))
    if not entries:
        raise ValueError(f"the merged table has none of the detail columns {list(cfg.detail_columns)}")
    first = F.min(F.struct(F.col("DateTime").isNull().alias("no_time"), "DateTime", RAW_FILE))
    return (
        valid.select(PROJECT_ID, "DateTime", RAW_FILE, F.inline(F.array(*entries)))
        .groupBy(PROJECT_ID, COLUMN, "column_ord", "value")
        .agg(F.count("*").alias("n_runs"), first.alias("_first"))
        .select(
            PROJECT_ID, COLUMN, "column_ord", "value", "n_runs",
            F.col("_first")["no_time"].alias("first_no_time"),
            F.col("_first")["DateTime"].alias("first_time"),
            F.col("_first")[RAW_FILE].alias("first_file"),
        )
    )


def in_first_seen_order(detail: DataFrame) -> DataFrame:
    return detail.orderBy("column_ord", "first_no_time", "first_time", "first_file", "value")
