"""Union of the report sources and pairing of regular with control runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.config import LedgerConfig
from runledger.functions import is_control, quoted, strip_suffix, to_number

SOURCE = "src_idx"
KEY = "_key"
CONTROL_TAG = "_iQC"


def column_union(frames: list[DataFrame]) -> tuple[list[set[str]], set[str]]:
    """Column names of each source, and of all together."""
    per_source = [set(f.columns) for f in frames]
    return per_source, set().union(*per_source)


def needed_columns(frames: list[DataFrame], cfg: LedgerConfig) -> list[str]:
    """Wanted columns that at least one source has, in catalogue order."""
    _, available = column_union(frames)
    cols = [c for c in cfg.report_columns if c in available]
    missing = [c for c in (cfg.name_column, cfg.time_column) if c not in cols]
    if missing:
        raise ValueError(f"no report source has the required columns {missing}; found {sorted(available)}")
    return cols


def _text_columns(frames: list[DataFrame], cols: list[str]) -> set[str]:
    """Columns that are text in one source and something else in another.

    They stay text in the union, since numbers are parsed only when needed.
    """
    found = set()
    for c in cols:
        types = {type(f.schema[c].dataType) for f in frames if c in f.columns}
        if T.StringType in types and len(types) > 1:
            found.add(c)
    return found


def union_reports(frames: list[DataFrame], cfg: LedgerConfig) -> DataFrame:
    """All rows of all sources with the needed columns; what a source lacks is NULL."""
    cols = needed_columns(frames, cfg)
    as_text = _text_columns(frames, cols)

    def part(i: int, f: DataFrame) -> DataFrame:
        picked = [
            (F.col(quoted(c)).cast("string") if c in as_text else F.col(quoted(c))).alias(c)
            for c in cols if c in f.columns
        ]
        return f.select(F.lit(i).alias(SOURCE), *picked)

    parts = [part(i, f) for i, f in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.select(SOURCE, *[quoted(c) for c in cols])


def report_columns_of(union: DataFrame) -> list[str]:
    return [c for c in union.columns if c != SOURCE]


def _clock(union: DataFrame, cfg: LedgerConfig) -> Column:
    return to_number(F.col(quoted(cfg.time_column)), union.schema[cfg.time_column].dataType)


def _survivor(union: DataFrame, cfg: LedgerConfig) -> Column:
    """A struct whose smallest value is the row to keep among copies of a run:
    first source, newest clock, then all columns."""
    clock = _clock(union, cfg)
    return F.struct(
        F.col(SOURCE).alias("_source"), clock.isNull().alias("_no_clock"), (-clock).alias("_age"),
        *[F.col(quoted(c)).alias(c) for c in report_columns_of(union)],
    )


def _first_per_key(rows: DataFrame, key: Column, cfg: LedgerConfig) -> DataFrame:
    # A filter on row_number() = 1 is applied to each input partition before the
    # shuffle too, so many copies of one run do not meet in one task.
    copies = Window.partitionBy(KEY).orderBy(_survivor(rows, cfg))
    return (
        rows.withColumn(KEY, key).withColumn("_rn", F.row_number().over(copies))
        .where("_rn = 1").select(*[quoted(c) for c in rows.columns])
    )


def split_regular_control(union: DataFrame, cfg: LedgerConfig) -> tuple[DataFrame, DataFrame]:
    """(regular runs, control runs); a NULL name is neither."""
    control = is_control(F.col(quoted(cfg.name_column)))
    return union.where(~control), union.where(control)


def dedup_regular(union: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """One row per regular run."""
    regular, _ = split_regular_control(union, cfg)
    return _first_per_key(regular, F.col(quoted(cfg.name_column)), cfg)


def dedup_control(union: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """One row per control run, whichever suffix it has."""
    _, control = split_regular_control(union, cfg)
    return _first_per_key(control, strip_suffix(F.col(quoted(cfg.name_column))), cfg)


def suffix_columns(df: DataFrame, suffix: str = CONTROL_TAG) -> DataFrame:
    return df.select(*[F.col(quoted(c)).alias(c + suffix) for c in df.columns])


def align_control(union: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Each run on one row: its regular values, and its control values under ``_iQC``.

    The outcome is a full outer join of the two deduplicated sides. As both are
    keyed by the bare run name, one aggregation gives it: a single scan and a
    single shuffle, with copies already reduced before the shuffle.
    """
    cols = report_columns_of(union)
    name = F.col(quoted(cfg.name_column))
    row = _survivor(union, cfg)
    runs = (
        union.where(name.isNotNull())
        .groupBy(strip_suffix(name).alias(KEY))
        .agg(F.min(F.when(~is_control(name), row)).alias("_r"), F.min(F.when(is_control(name), row)).alias("_c"))
    )
    return runs.select(
        KEY,
        *[F.col("_r").getField(c).alias(c) for c in cols],
        *[F.col("_c").getField(c).alias(c + CONTROL_TAG) for c in cols],
    )
