"""Questions about projects: slices, valid and failed runs, newest measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import contains_ci, last_measured_text
from runledger.operators.merge import ERROR, PROJECT_ID, RAW_FILE


def time_order() -> list[Column]:
    """Oldest first, runs without a time last, file name as tie-break."""
    return [F.col("DateTime").asc_nulls_last(), F.col(RAW_FILE).asc_nulls_last()]


def project_filter(merged: DataFrame, project: str, match: str = "exact") -> DataFrame:
    """Rows of one project. ``like`` reads ``_`` and ``%`` in the name as wildcards."""
    if match == "exact":
        return merged.where(F.col(PROJECT_ID) == project)
    if match == "like":
        # Backslash escapes in Spark's LIKE; here it stands for itself.
        return merged.where(F.col(PROJECT_ID).like(project.replace("\\", "\\\\")))
    raise ValueError(f"match must be 'exact' or 'like', got {match!r}")


def project_slice(merged: DataFrame, project: str, match: str = "like") -> DataFrame:
    """All rows and columns of a project in time order."""
    return project_filter(merged, project, match).orderBy(*time_order())


def is_error() -> Column:
    """Failed run: an error is noted, or the date is before 2000. No date is no failure."""
    return F.coalesce(F.col("Date") < F.lit("2000-01-01").cast("date"), F.lit(False)) | F.col(ERROR).isNotNull()


def split_valid_error(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merged.where(~is_error()), merged.where(is_error())


def error_table(merged: DataFrame) -> DataFrame:
    """Failed runs of every project, under the headings of the report."""
    _, failed = split_valid_error(merged)
    return failed.select(PROJECT_ID, F.col(RAW_FILE).alias("Rawfile Name"), F.col(ERROR).alias("Error"))


def projects_by_recency(merged: DataFrame) -> DataFrame:
    """Every project once, with the time of its newest run; newest project first."""
    return (
        merged.groupBy(PROJECT_ID).agg(F.max("DateTime").alias("newest"))
        .orderBy(F.col("newest").desc_nulls_last(), F.col(PROJECT_ID).asc())
    )


def project_page(merged: DataFrame, limit: int = 200) -> DataFrame:
    """The first projects by recency; the first row is the default choice."""
    return projects_by_recency(merged).limit(limit)


def search_projects(merged: DataFrame, pattern: str | None, limit: int | None = 100) -> DataFrame:
    """Projects whose name contains the text, in any case; all of them without a text. No limit when it is None."""
    hits = merged.where(contains_ci(F.col(PROJECT_ID), pattern)) if pattern else merged
    found = projects_by_recency(hits)
    return found if limit is None else found.limit(limit)


def newest_run() -> Column:
    """Greatest for the last row in time order, where runs without a time come last."""
    return F.struct(F.col("DateTime").isNull().alias("no_time"), "DateTime", RAW_FILE)


def last_measured(merged: DataFrame) -> DataFrame:
    """Newest run of each project, failed runs included."""
    return (
        merged.groupBy(PROJECT_ID).agg(F.max(newest_run()).alias("_last"))
        .select(PROJECT_ID, F.col("_last")[RAW_FILE].alias("last_measured"), F.col("_last")["DateTime"].alias("last_measured_time"))
        .withColumn("last_measured_text", last_measured_text(F.col("last_measured"), F.col("last_measured_time")))
    )


def project_overview(merged: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """One row per project from one aggregation: counts, newest run, layout."""
    return (
        merged.groupBy(PROJECT_ID)
        .agg(
            F.count_if(~is_error()).alias("n_valid"),
            F.count_if(is_error()).alias("n_error"),
            F.max("DateTime").alias("newest"),
            F.max(newest_run()).alias("_last"),
        )
        .select(
            PROJECT_ID, "n_valid", "n_error", "newest",
            F.col("_last")[RAW_FILE].alias("last_measured"),
            F.col("_last")["DateTime"].alias("last_measured_time"),
            (F.col("n_valid") >= cfg.layout_threshold).alias("single_column"),
        )
        .withColumn("last_measured_text", last_measured_text(F.col("last_measured"), F.col("last_measured_time")))
    )
