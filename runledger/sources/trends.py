"""Trends on disk that follow the merged table.

A base of trend rows, and small parts with the rows that upserts have changed since. Each part comes with the identities
of the rows that it replaces. Where the frames of the changed runs may cover a whole project, its trends are stated anew, and the part names
the project in place of its rows. The manifest says which state of the merged table the trends belong to.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.operators import metrics
from runledger.operators.maintain import IDENTITY, changed_trends, replaced, same
from runledger.operators.merge import PROJECT_ID
from runledger.operators.metrics import METRIC
from runledger.session import materialised
from runledger.sources import files
from runledger.sources.store import MergedTable

log = logging.getLogger(__name__)
MAX_PARTS = 8
_SEQ, _LATER = "_seq", "_later"


class TrendTable:
    def __init__(self, spark: SparkSession, root: str, cfg: LedgerConfig) -> None:
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg
        self.manifests = files.Manifests(spark, self.root)

    def _stage(self, rows: DataFrame) -> str:
        part = files.new_part()
        rows.write.parquet(f"{self.root}/{part}")
        return part

    def _load(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{part}")

    def _publish(self, after: int, state: dict) -> None:
        files.require(self.spark, self.root, [state["base"], *(p for pair in state["parts"] for p in pair)])
        self.manifests.publish(after, state)

    def rebuild(self, table: MergedTable) -> None:
        """All trends anew from the table as it is."""
        number = table.number
        rows = metrics.metric_trends(materialised(metrics.series_columns(table.read(), self.cfg)), self.cfg)
        # A project stands in one file unless it was split. Ranges would be sampled, and all windows computed twice for that.
        base = self._stage(rows.sortWithinPartitions(PROJECT_ID, METRIC, "DateTime"))
        latest = self.manifests.latest()
        self._publish(latest[0] if latest else 0, {"of": number, "base": base, "parts": []})

    def follow(self, table: MergedTable, held: int, before: DataFrame, after: DataFrame) -> None:
        """Take in an upsert that replaced ``before`` by ``after``, when the trends are those of the table's state ``held``; else rebuild."""
        latest = self.manifests.latest()
        if latest is None or latest[1]["of"] != held:
            log.info("trends are not those of state %d; all are computed", held)
            self.rebuild(table)
            return
        number, state = latest
        of = table.number
        parts, base = [*state["parts"], self._stage_changes(table.read(), before, after)], state["base"]
        if len(parts) >= MAX_PARTS:
            base, parts = self._stage(self._rows(base, parts)), []
        self._publish(number, {"of": of, "base": base, "parts": parts})

    def _stage_changes(self, merged: DataFrame, before: DataFrame, after: DataFrame) -> list[str]:
        """Stage the trend rows that an upsert changes and the IDENTITY of those they replace; then, for projects that are stated whole,
        all their trend rows and their names."""
        changes = before.select(PROJECT_ID).unionByName(after.select(PROJECT_ID))
        touched = materialised(changes.groupBy(PROJECT_ID).agg(F.count("*").alias("_changed")))
        # Read once for the steps below; small lists of projects are broadcast by their stored size.
        runs = materialised(metrics.series_columns(merged.join(touched, same(merged, touched, [PROJECT_ID]), "left_semi"), self.cfg))
        sizes = runs.groupBy(F.col(PROJECT_ID).alias("_project")).agg(F.count("*").alias("_runs"))
        sized = touched.join(sizes, touched[PROJECT_ID].eqNullSafe(sizes["_project"]), "left")
        frames = F.col("_changed") * self.cfg.rolling_width
        whole = self._stage(sized.where(frames >= F.coalesce("_runs", F.lit(0))).select(PROJECT_ID))
        names = self._load(whole)
        here = lambda df, kind: df.join(names, same(df, names, [PROJECT_ID]), kind)
        few = [here(df, "left_anti") for df in (runs, before, after)]
        rows = self._stage(changed_trends(*few, self.cfg))
        gone = self._stage(replaced(few[1], self._load(rows), self.cfg))
        anew = self._stage(metrics.metric_trends(here(runs, "left_semi"), self.cfg))
        return [rows, gone, anew, whole]

    def _rows(self, base: str, parts: list[list[str]]) -> DataFrame:
        """The newest rows; parts of earlier manifests have rows and identities only."""
        union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
        rows = [self._load(base).withColumn(_SEQ, F.lit(0))]
        gone: dict[int, list[DataFrame]] = {1: [], 3: []}
        for i, part in enumerate(parts, 1):
            rows += [self._load(p).withColumn(_SEQ, F.lit(i)) for p in part[0::2]]
            for at in range(1, len(part), 2):
                gone[at].append(self._load(part[at]).withColumn(_LATER, F.lit(i)))
        left = union(rows)
        # Whole projects first: their list is short, and little is left to compare row by row.
        for at, columns in ((3, [PROJECT_ID]), (1, IDENTITY)):
            if gone[at]:
                later = union(gone[at]).groupBy(*columns).agg(F.max(_LATER).alias(_LATER))
                left = left.join(later, same(left, later, columns) & (left[_SEQ] < later[_LATER]), "left_anti")
        return left.drop(_SEQ)

    def read(self) -> DataFrame:
        latest = self.manifests.latest()
        if latest is None:
            raise FileNotFoundError(f"no trends at {self.root}")
        return self._rows(latest[1]["base"], latest[1]["parts"])

    def vacuum(self, keep: int = 2, grace: float = files.GRACE_SECONDS) -> int:
        """Delete folders that none of the newest ``keep`` manifests names and that are older than ``grace`` seconds."""
        used = set()
        for n in self.manifests.numbers()[-keep:]:
            state = self.manifests.read(n)
            used |= {state["base"], *(p for pair in state["parts"] for p in pair)}
        return files.remove_stale(self.spark, self.root, used, grace)
