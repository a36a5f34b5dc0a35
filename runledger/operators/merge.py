"""The merge of reports, sample metadata and project metadata into one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import (
    date_time,
    derive_project,
    file_type,
    quoted,
    strip_suffix,
    time_of_day,
)
from runledger.operators.reports import CONTROL_TAG, KEY, align_control, union_reports
from runledger.operators.skew import hot_groups, split_by

# Column names of the metadata tables and of the merged table.
SAMPLE_ID = "SampleName_ID"
PROJECT_ID = "ProjectID"
CREATED = "CreationDate"
ERROR = "Error"
TIME_RANGE = "TimeRange"
RAW_FILE = "RawFileName"

SAMPLE_KEY = "_sample_key"
SAMPLE_PROJECT = "_sample_project"


def prepare_samples(samples: DataFrame) -> DataFrame:
    """Sample metadata with its join key."""
    missing = [c for c in (SAMPLE_ID, PROJECT_ID, CREATED) if c not in samples.columns]
    if missing:
        raise ValueError(f"sample metadata lacks {missing}; found {samples.columns}")
    return (
        samples.withColumnRenamed(PROJECT_ID, SAMPLE_PROJECT)
        .withColumn(SAMPLE_KEY, strip_suffix(F.col(SAMPLE_ID)))
    )


def attach_samples(aligned: DataFrame, samples: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Full outer join of runs and samples on the bare file name.

    Runs are unique by key. Samples need not be: those without a key match
    nothing and skip the join, and keys with very many samples get their single
    run by broadcast instead of meeting in one task.
    """
    # Asked of the stored column, so that the scan can skip row groups by it.
    keyed = samples.where(F.col(SAMPLE_ID).isNotNull())
    unkeyed = samples.where(F.col(SAMPLE_ID).isNull())
    counts = keyed.groupBy(SAMPLE_KEY).count()
    hot = hot_groups(keyed, counts, [SAMPLE_KEY], cfg)
    if hot is None:
        joined = aligned.join(keyed, F.col(KEY) == F.col(SAMPLE_KEY), "full_outer")
    else:
        few, many = split_by(keyed, hot, [SAMPLE_KEY])
        runs = aligned.withColumn(SAMPLE_KEY, F.col(KEY))
        other_runs, hot_runs = split_by(runs, hot, [SAMPLE_KEY])
        joined = (
            other_runs.drop(SAMPLE_KEY).join(few, F.col(KEY) == F.col(SAMPLE_KEY), "full_outer")
            # One run per hot key at most, so this side is bounded as the keys are.
            .unionByName(many.join(F.broadcast(hot_runs), SAMPLE_KEY, "left"))
        )
    return joined.unionByName(unkeyed, allowMissingColumns=True)


def attach_project_meta(base: DataFrame, projects: DataFrame) -> DataFrame:
    """Left join of the project attributes; several rows of one project fan out.

    No hint: Spark broadcasts the project table when its size allows, and
    otherwise sorts and merges, splitting large projects at run time.
    """
    attributes = projects.drop(TIME_RANGE)
    clash = sorted({c.lower() for c in attributes.columns if c != PROJECT_ID} & {c.lower() for c in base.columns})
    if clash:
        raise ValueError(f"project metadata repeats columns of the merged table: {clash}")
    return base.join(attributes, PROJECT_ID, "left").select(
        *[quoted(c) for c in base.columns],
        *[quoted(c) for c in attributes.columns if c != PROJECT_ID],
    )


def merge_base(aligned: DataFrame, samples: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Runs with samples, and the columns derived from both."""
    metadata = prepare_samples(samples)
    rows = attach_samples(aligned, metadata, cfg)
    clock = F.coalesce(F.col(quoted(cfg.time_column)), F.col(quoted(cfg.time_column + CONTROL_TAG)))
    raw_file = F.coalesce(F.col(SAMPLE_KEY), F.col(KEY))
    report_cols = [c for c in aligned.columns if c != KEY]
    sample_cols = [c for c in metadata.columns if c not in (SAMPLE_KEY, SAMPLE_PROJECT)]
    clash = sorted({c.lower() for c in sample_cols} & {c.lower() for c in report_cols})
    if clash:
        raise ValueError(f"sample metadata repeats columns of the reports: {clash}")
    return (
        rows.withColumn("_when", date_time(F.col(CREATED), clock))
        .withColumn(RAW_FILE, raw_file)
        .select(
            *[quoted(c) for c in report_cols],
            *[quoted(c) for c in sample_cols],
            RAW_FILE,
            F.coalesce(F.col(SAMPLE_PROJECT), derive_project(F.col(KEY))).alias(PROJECT_ID),
            F.to_date("_when").alias("Date"),
            time_of_day(F.col("_when")).alias("Time"),
            F.col("_when").alias("DateTime"),
            file_type(F.col(RAW_FILE), cfg.standards_mode).alias("FileType"),
        )
    )


def merge_sources(
    reports: list[DataFrame], samples: DataFrame, projects: DataFrame, cfg: LedgerConfig
) -> DataFrame:
    """The merged table: one row per run or sample, whatever source knows it.

    ``Error`` may stand in the sample or in the project table; when neither has it, it is added without values.
    """
    aligned = align_control(union_reports(reports, cfg), cfg)
    rows = attach_project_meta(merge_base(aligned, samples, cfg), projects)
    if ERROR in rows.columns:
        return rows
    at = rows.columns.index(RAW_FILE)
    cols = [F.col(quoted(c)) for c in rows.columns]
    return rows.select(*cols[:at], F.lit(None).cast("string").alias(ERROR), *cols[at:])
