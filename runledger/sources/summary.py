"""The summary of every project on disk, which follows the merged table.

One row a project: valid and failed runs, newest time, last run. An upsert takes away what the replaced rows gave and adds what the new ones
give; only where it takes away a maximum are the runs of that project read again. So the start page, the search and the overview read
no file of the merged table.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import last_measured_text
from runledger.operators.merge import ERROR, PROJECT_ID, RAW_FILE
from runledger.operators.projects import is_error, newest_run
from runledger.session import materialised
from runledger.sources import files
from runledger.sources.store import MergedTable

log = logging.getLogger(__name__)
MAX_PARTS = 8
_KEY, _SEQ = "_key", "_seq"


def project_key(column: Column) -> Column:
    """The project as a key that is never NULL."""
    return F.coalesce(F.concat(F.lit("p"), column), F.lit(""))


def measures(rows: DataFrame) -> DataFrame:
    """``_key``, n_valid, n_error, newest, last of each project of some rows of the merged table."""
    cut = rows.select(project_key(F.col(PROJECT_ID)).alias(_KEY), "DateTime", RAW_FILE, "Date", ERROR)
    return cut.groupBy(_KEY).agg(
        F.count_if(~is_error()).alias("n_valid"), F.count_if(is_error()).alias("n_error"), F.max("DateTime").alias("newest"), F.max(newest_run()).alias("last"))


def followed(old: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The measures of the projects of ``before`` and ``after`` (rows of the merged table) from their ``old`` ones, and ``_lost``:
    is the newest time or the last run no longer known?"""
    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(_KEY, *[F.col(c).alias(f"{c}_{suffix}") for c in ("n_valid", "n_error", "newest", "last")])

    b, a = materialised(measures(before)), materialised(measures(after))
    touched = b.select(_KEY).unionByName(a.select(_KEY)).distinct()
    all_ = touched.join(named(old, "o"), _KEY, "left").join(named(b, "b"), _KEY, "left").join(named(a, "a"), _KEY, "left")
    zero = F.lit(0)
    count = lambda c: (F.coalesce(f"{c}_o", zero) - F.coalesce(f"{c}_b", zero) + F.coalesce(f"{c}_a", zero)).alias(c)

    def lost(c: str) -> Column:
        taken = F.coalesce(F.col(f"{c}_b") >= F.col(f"{c}_o"), F.lit(False))
        return taken & ~F.coalesce(F.col(f"{c}_a") >= F.col(f"{c}_o"), F.lit(False))

    return all_.select(
        _KEY, count("n_valid"), count("n_error"), F.greatest("newest_o", "newest_a").alias("newest"), F.greatest("last_o", "last_a").alias("last"),
        (lost("newest") | lost("last")).alias("_lost"))


class SummaryTable:
    def __init__(self, spark: SparkSession, root: str, cfg: LedgerConfig) -> None:
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg
        self.manifests = files.Manifests(spark, self.root)

    def _stage(self, rows: DataFrame) -> str:
        part = files.new_part()
        rows.write.parquet(f"{self.root}/{part}")
        return part

    def _publish(self, after: int, state: dict) -> None:
        files.require(self.spark, self.root, state["parts"])
        self.manifests.publish(after, state)

    def rebuild(self, table: MergedTable) -> None:
        """All summaries anew from the table as it is."""
        number, latest = table.number, self.manifests.latest()
        self._publish(latest[0] if latest else 0, {"of": number, "parts": [self._stage(measures(table.read()))]})

    def follow(self, table: MergedTable, held: int, before: DataFrame, after: DataFrame) -> int:
        """Take in an upsert that replaced ``before`` by ``after``, when the summaries are those of the table's state ``held``; else rebuild.

        Returns how many projects were read again.
        """
        latest = self.manifests.latest()
        if latest is None or latest[1]["of"] != held:
            log.info("summaries are not those of state %d; all are computed", held)
            self.rebuild(table)
            return -1
        number, state = latest
        of = table.number
        new = materialised(followed(self._rows(state["parts"]), before, after))
        lost = new.where("_lost AND n_valid + n_error > 0").select(_KEY)
        again = lost.count()
        rows = new.where("NOT _lost OR n_valid + n_error <= 0").drop("_lost")
        if again:
            names = lost.select(F.when(F.col(_KEY) != "", F.substring(F.col(_KEY), F.lit(2), F.length(_KEY))).alias("_project"))
            runs = table.read()
            rows = rows.unionByName(measures(runs.join(names, runs[PROJECT_ID].eqNullSafe(names["_project"]), "left_semi")))
        parts = [*state["parts"], self._stage(rows)]
        if len(parts) >= MAX_PARTS:
            parts = [self._stage(self._rows(parts))]
        self._publish(number, {"of": of, "parts": parts})
        return again

    def _rows(self, parts: list[str]) -> DataFrame:
        """The newest row of each project that still has runs."""
        tagged = [self.spark.read.parquet(f"{self.root}/{p}").withColumn(_SEQ, F.lit(i)) for i, p in enumerate(parts)]
        rows = reduce(lambda a, b: a.unionByName(b), tagged)
        if len(parts) > 1:
            newest = rows.groupBy(_KEY).agg(F.max(_SEQ).alias(_SEQ))
            rows = rows.join(newest, [_KEY, _SEQ])
        return rows.drop(_SEQ).where("n_valid + n_error > 0")

    def read(self) -> DataFrame:
        """The columns of ``project_overview``."""
        latest = self.manifests.latest()
        if latest is None:
            raise FileNotFoundError(f"no summaries at {self.root}")
        project = F.when(F.col(_KEY) != "", F.substring(F.col(_KEY), F.lit(2), F.length(_KEY)))
        return self._rows(latest[1]["parts"]).select(
            project.alias(PROJECT_ID), "n_valid", "n_error", "newest", F.col("last")[RAW_FILE].alias("last_measured"),
            F.col("last")["DateTime"].alias("last_measured_time"), (F.col("n_valid") >= self.cfg.layout_threshold).alias("single_column"),
        ).withColumn("last_measured_text", last_measured_text(F.col("last_measured"), F.col("last_measured_time")))

    def start_page(self, limit: int = 200) -> DataFrame:
        """Newest projects first, as ``project_page``."""
        return self.read().select(PROJECT_ID, "newest").orderBy(F.col("newest").desc_nulls_last(), F.col(PROJECT_ID).asc()).limit(limit)

    def vacuum(self, keep: int = 2, grace: float = files.GRACE_SECONDS) -> int:
        """Delete folders that none of the newest ``keep`` manifests names and that are older than ``grace`` seconds."""
        used = {p for n in self.manifests.numbers()[-keep:] for p in self.manifests.read(n)["parts"]}
        return files.remove_stale(self.spark, self.root, used, grace)
