"""Upsert of recent rows into the merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runledger.config import LedgerConfig
from runledger.functions import quoted, strip_suffix
from runledger.operators.merge import RAW_FILE, SAMPLE_ID, merge_sources
from runledger.operators.recent import RECENT_ID


def bounded(keys: DataFrame, rows: int, cfg: LedgerConfig) -> DataFrame:
    """Broadcast a key list whose row count is known to be within the limit."""
    return F.broadcast(keys) if rows <= cfg.broadcast_rows else keys


def recent_semi(merged: DataFrame, recent_ids: DataFrame) -> DataFrame:
    """Merged rows whose file is in the list of recent samples."""
    ids = recent_ids.select(F.col(RECENT_ID).alias(RAW_FILE))
    return merged.join(ids, RAW_FILE, "left_semi").select(*[quoted(c) for c in merged.columns])


def dedup_upserts(rows: DataFrame) -> DataFrame:
    """One row per file: newest first, then by sample name, then by all columns."""
    rest = [c for c in rows.columns if c not in (RAW_FILE, "DateTime", SAMPLE_ID)]
    copies = Window.partitionBy(RAW_FILE).orderBy(
        F.col("DateTime").desc_nulls_last(), F.col(SAMPLE_ID).asc_nulls_last(),
        *[F.col(quoted(c)).asc_nulls_last() for c in rest],
    )
    return (
        rows.withColumn("_rn", F.row_number().over(copies)).where("_rn = 1")
        .select(*[quoted(c) for c in rows.columns])
    )


def recent_merge(
    reports: list[DataFrame], samples: DataFrame, projects: DataFrame,
    recent: DataFrame, recent_rows: int, cfg: LedgerConfig,
) -> DataFrame:
    """The merge restricted to recent samples.

    The file name of a merged row equals the bare name in each of its inputs, so
    the inputs are cut down before the joins: the large tables are only scanned,
    never shuffled.
    """
    ids = recent.where(F.col(RECENT_ID).isNotNull()).select(RECENT_ID).distinct()

    def cut(df: DataFrame, name: str) -> DataFrame:
        keyed = df.withColumn(RECENT_ID, strip_suffix(F.col(quoted(name))))
        return keyed.join(bounded(ids, recent_rows, cfg), RECENT_ID, "left_semi").select(*[quoted(c) for c in df.columns])

    return merge_sources(
        [cut(r, cfg.name_column) for r in reports], cut(samples, SAMPLE_ID), projects, cfg)


def fit_target(updates: DataFrame, target: StructType) -> DataFrame:
    """Updates with the columns and types of the target.

    New columns are left out; lost ones are an error, and so are values that do not fit.
    """
    lost = [c for c in target.names if c not in updates.columns]
    if lost:
        raise ValueError(f"the sources no longer give these columns of the merged table: {lost}")
    return updates.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in target.fields])


def merge_upsert(target: DataFrame, updates: DataFrame, update_rows: int, cfg: LedgerConfig) -> DataFrame:
    """The target after the upsert: matched files replaced, others inserted.

    ``updates`` is unique by file and ``update_rows`` bounds its size, so the
    target is not shuffled. Rows without a file name never match.
    """
    keys = updates.select(RAW_FILE)
    kept = target.join(bounded(keys, update_rows, cfg), RAW_FILE, "left_anti")
    return kept.select(*[quoted(c) for c in target.columns]).unionByName(fit_target(updates, target.schema))


def refresh_counts(
    target: DataFrame, updates: DataFrame, recent: DataFrame, update_rows: int, cfg: LedgerConfig
) -> DataFrame:
    """One row: rows before and after, rows updated and inserted, recent samples looked at."""
    known = target.where(F.col(RAW_FILE).isNotNull()).select(RAW_FILE)
    matched = known.join(bounded(updates.select(RAW_FILE), update_rows, cfg), RAW_FILE, "left_semi")

    def counted(df: DataFrame, what: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")

    parts = counted(target, "before").unionByName(counted(matched, "updated"))
    parts = parts.unionByName(counted(updates, "given")).unionByName(counted(recent, "recent"))
    n = {w: F.sum(F.when(F.col("what") == w, F.col("n"))) for w in ("before", "updated", "given", "recent")}
    return parts.agg(
        n["before"].alias("rows_before"),
        n["updated"].alias("rows_updated"),
        (n["given"] - n["updated"]).alias("rows_inserted"),
        (n["before"] + n["given"] - n["updated"]).alias("rows_final"),
        n["recent"].alias("samples_processed"),
    )
