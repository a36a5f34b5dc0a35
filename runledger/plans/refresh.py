"""Full and incremental refresh of the merged table."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import quoted, strip_suffix
from runledger.operators.differences import changed_keys
from runledger.operators.merge import PROJECT_ID, RAW_FILE, SAMPLE_ID, merge_sources
from runledger.operators.recent import RECENT_ID, recent_samples
from runledger.operators.upsert import bounded, dedup_upserts, fit_target, recent_merge
from runledger.session import materialised, temporary_tables
from runledger.sources.audit import AuditLog, entry
from runledger.sources.databases import PinnedSource, SourceDatabase, read_project_meta, read_reports, read_sample_meta, source_mtimes
from runledger.sources.store import MergedTable
from runledger.sources.summary import SummaryTable
from runledger.sources.trends import TrendTable

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RefreshResult:
    """What a refresh did. ``samples`` counts the samples looked at."""

    full: bool
    rows_before: int
    rows_final: int
    rows_updated: int
    rows_inserted: int
    samples: int


@dataclass(frozen=True)
class Inputs:
    """The sources of a refresh as DataFrames, each at one version.

    ``versions`` names the version of each source that has any.
    """

    reports: list[DataFrame]
    samples: DataFrame
    projects: DataFrame
    versions: dict[str, str] | None = None

    @classmethod
    def load(
        cls, spark: SparkSession, reports: list[SourceDatabase], metadata: SourceDatabase, cfg: LedgerConfig,
    ) -> Inputs:
        """All tables at the newest versions, looked up once: what lands meanwhile waits for the next refresh."""
        pins = [s.pinned(spark) for s in reports]
        meta = metadata.pinned(spark)
        versions = {p.name: p.version for p in (*pins, meta) if isinstance(p, PinnedSource)}
        return cls(
            read_reports(spark, pins, cfg), read_sample_meta(spark, meta, cfg), read_project_meta(spark, meta, cfg), versions)

    def changed_samples(
        self, spark: SparkSession, reports: list[SourceDatabase], metadata: SourceDatabase, table: MergedTable,
    ) -> DataFrame:
        """File names (RECENT_ID) of all rows that differ from the versions the table holds."""
        cfg, held = table.cfg, table.versions()

        def before(source: SourceDatabase, which: str) -> DataFrame | None:
            """The table at the version held; None when that is unknown or gone, then all its rows count as changed."""
            version = held.get(source.name)
            if version is None or source.name not in (self.versions or {}):
                return None
            try:
                return source.pinned(spark, version).read(spark, which)
            except (PySparkException, Py4JJavaError, ValueError):
                log.info("version %s of %s is gone; all its rows count as changed", version, source.name)
                return None

        same = lambda source: source.name in held and held[source.name] == (self.versions or {}).get(source.name)
        parts = []
        for source, new in zip(reports, self.reports):
            if not same(source):
                parts.append(changed_keys(new, before(source, cfg.report_tables[0]), strip_suffix(F.col(quoted(cfg.name_column))), RECENT_ID))
        if not same(metadata):
            old = before(metadata, cfg.metadata_tables[1])
            parts.append(changed_keys(self.samples, old, strip_suffix(F.col(SAMPLE_ID)), RECENT_ID))
            projects = changed_keys(self.projects, before(metadata, cfg.metadata_tables[0]), F.col(PROJECT_ID), PROJECT_ID)
            files = table.read().join(projects, PROJECT_ID, "left_semi").where(F.col(RAW_FILE).isNotNull())
            parts.append(files.select(F.col(RAW_FILE).alias(RECENT_ID)))
        return reduce(lambda a, b: a.unionByName(b), parts, spark.createDataFrame([], f"{RECENT_ID} string"))

    def all_samples(self, cfg: LedgerConfig) -> DataFrame:
        """File names of all rows of reports and samples."""
        parts = [r.select(strip_suffix(F.col(quoted(cfg.name_column))).alias(RECENT_ID)) for r in self.reports]
        parts.append(self.samples.select(strip_suffix(F.col(SAMPLE_ID)).alias(RECENT_ID)))
        return reduce(lambda a, b: a.unionByName(b), parts)


def audit_log(table: MergedTable) -> AuditLog:
    return AuditLog(table.spark, table.root, table.generation)


def full_refresh(table: MergedTable, inputs: Inputs, mtimes: DataFrame, step: tuple[str, int] | None = None) -> RefreshResult:
    """Build the merged table anew and start a new refresh log.

    One lazy plan, one write. The uniqueness check reads only the key column of
    what was written; the old table stays in place if it fails.
    """
    before = table.row_count() if table.exists() else 0
    merged = merge_sources(inputs.reports, inputs.samples, inputs.projects, table.cfg)
    rows = table.replace(merged, inputs.versions, audit=entry(mtimes), step=step)
    return RefreshResult(True, before, rows, 0, rows, 0)


def incremental_refresh(
    table: MergedTable, inputs: Inputs, mtimes: DataFrame, n: int | None = None, changed: DataFrame | None = None,
    trends: TrendTable | None = None, step: tuple[str, int] | None = None, summary: SummaryTable | None = None,
) -> RefreshResult | None:
    """Upsert every sample that changed; None, and no log entry, when there are none.

    ``changed`` has their file names; without it all rows of the inputs count as changed. ``n`` asks for a look-back
    beside them: the newest ``n`` samples of each source are upserted too, changed or not. Inputs are cut to these
    samples before the joins; the list of them is broadcast only when it is short. ``trends`` and ``summary`` are brought up to date with the table.
    """
    with temporary_tables(table.spark):
        return _incremental_refresh(table, inputs, mtimes, n, changed, trends, step, summary)


def _incremental_refresh(
    table: MergedTable, inputs: Inputs, mtimes: DataFrame, n: int | None, changed: DataFrame | None, trends: TrendTable | None,
    step: tuple[str, int] | None, summary: SummaryTable | None,
) -> RefreshResult | None:
    cfg = table.cfg
    looked = inputs.all_samples(cfg) if changed is None else changed
    if n:
        looked = looked.unionByName(recent_samples(inputs.reports, inputs.samples, n, cfg).select(RECENT_ID))
    recent = materialised(looked.where(F.col(RECENT_ID).isNotNull()).distinct())
    samples = recent.count()
    if samples == 0:
        log.info("no changed samples")
        return None
    before = table.row_count()
    merged = recent_merge(inputs.reports, inputs.samples, inputs.projects, recent, samples, cfg)
    part = table.stage(dedup_upserts(fit_target(merged, table.schema())))
    given = table.staged(part)
    updates = given.count()
    # Updates are unique by file and every file is in the list of recent samples.
    known = table.holding(given.select(RAW_FILE)).where(F.col(RAW_FILE).isNotNull())
    updated = known.join(bounded(given.select(RAW_FILE), updates, cfg), RAW_FILE, "left_semi").count()
    rows = upsert_with_trends(table, part, updates, updates - updated, trends, inputs.versions, entry(mtimes), step, summary)
    return RefreshResult(False, before, rows, updated, updates - updated, samples)


def upsert_with_trends(
    table: MergedTable, part: str, updates: int, inserted: int, trends: TrendTable | None = None, versions: dict[str, str] | None = None,
    audit: dict | None = None, step: tuple[str, int] | None = None, summary: SummaryTable | None = None,
) -> int:
    """Upsert a staged part, then bring ``trends`` and ``summary`` up to date from the rows replaced and brought. Returns the row count."""
    followers = [f for f in (trends, summary) if f is not None]
    if not followers:
        return table.upsert(part, updates, inserted, versions, audit, step)
    given = table.staged(part)
    known = given.where(F.col(RAW_FILE).isNotNull()).select(RAW_FILE)
    before, held = materialised(table.rows_of(known, updates)), table.number
    rows = table.upsert(part, updates, inserted, versions, audit, step)
    for follower in followers:
        follower.follow(table, held, before, given)
    return rows


def refresh(
    table: MergedTable, reports: list[SourceDatabase], metadata: SourceDatabase, n: int | None = None, full: bool = False,
    step: tuple[str, int] | None = None,
) -> RefreshResult | None:
    """Build anew or upsert what changed. A ``step`` (stream, number) that the table has done before is not done again."""
    spark = table.spark
    if table.has_done(step):
        log.info("step %s is done", step)
        return None
    inputs = Inputs.load(spark, reports, metadata, table.cfg)
    mtimes = source_mtimes(spark, [*reports, metadata])
    if full:
        return full_refresh(table, inputs, mtimes, step)
    return incremental_refresh(table, inputs, mtimes, n, inputs.changed_samples(spark, reports, metadata, table), step=step)
