"""The engine as one object: sources in, merged table and its answers out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.config import LedgerConfig
from runledger.operators import detail, metrics, projects
from runledger.plans.refresh import RefreshResult, audit_log, refresh
from runledger.plans.reports import report_tables
from runledger.session import shuffle_partitions_for
from runledger.sources import audit, export
from runledger.sources.databases import SNAPSHOT, SourceDatabase, source_bytes, validate_sources
from runledger.sources.files import GRACE_SECONDS
from runledger.sources.snapshot import sync_sources, vacuum_snapshot
from runledger.sources.store import MergedTable


class Ledger:
    """Reports and metadata of any number of instruments under one root folder.

    The root must be on storage that driver and executors share.
    """

    def __init__(
        self, spark: SparkSession, root: str, reports: SourceDatabase | list[SourceDatabase],
        metadata: SourceDatabase, cfg: LedgerConfig | None = None,
    ) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.reports = reports if isinstance(reports, list) else [reports]
        self.metadata = metadata
        self.cfg = cfg or LedgerConfig()
        self.table = MergedTable(spark, f"{self.root}/merged", self.cfg)
        names = [s.name for s in self.sources]
        if len(set(names)) != len(names):
            raise ValueError(f"source names repeat: {names}")

    @property
    def sources(self) -> list[SourceDatabase]:
        return [*self.reports, self.metadata]

    # --- sources --------------------------------------------------------------

    def validate(self) -> None:
        validate_sources(self.spark, self.cfg, self.reports, self.metadata)

    def working(self, source: SourceDatabase) -> SourceDatabase:
        """The copy a refresh reads; immutable sources are read in place."""
        if source.immutable:
            return source
        return SourceDatabase(source.name, f"{self.root}/sources/{source.name}", SNAPSHOT)

    def sync(self, sources: list[SourceDatabase] | None = None) -> bool:
        """Copy the sources that can change under a reader."""
        chosen = [s for s in (self.sources if sources is None else sources) if not s.immutable]
        if not chosen:
            return True
        return sync_sources(self.spark, chosen, [self.working(s).location for s in chosen])

    def size_shuffles(self) -> int:
        """Set the number of shuffle partitions by the size of the sources."""
        n = shuffle_partitions_for(source_bytes(self.spark, self.sources))
        self.spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return n

    # --- refresh --------------------------------------------------------------

    def refresh(self, n: int | None = None, full: bool = False, step: tuple[str, int] | None = None) -> RefreshResult | None:
        """Upsert all that changed in the working copies, and the newest ``n`` samples of each source if asked; or build anew."""
        reports = [self.working(s) for s in self.reports]
        return refresh(self.table, reports, self.working(self.metadata), n, full, step)

    def bootstrap(self) -> RefreshResult | None:
        """Check and copy the sources and build the merged table."""
        self.validate()
        if not self.sync():
            raise RuntimeError("not all sources could be copied")
        return self.refresh(full=True)

    # --- questions ------------------------------------------------------------

    def merged(self) -> DataFrame:
        return self.table.read()

    def projects(self, pattern: str | None = None, limit: int | None = None) -> DataFrame:
        """Projects, newest first: all, those that match, or the first ``limit`` of either."""
        if pattern is None and limit is None:
            return projects.projects_by_recency(self.merged())
        return projects.search_projects(self.merged(), pattern, limit)

    def start_page(self, limit: int = 200) -> DataFrame:
        return projects.project_page(self.merged(), limit)

    def project(self, project: str, match: str = "like") -> DataFrame:
        return projects.project_slice(self.merged(), project, match)

    def overview(self) -> DataFrame:
        return projects.project_overview(self.merged(), self.cfg)

    def errors(self) -> DataFrame:
        return projects.error_table(self.merged())

    def detail(self) -> DataFrame:
        return detail.project_detail(self.merged(), self.cfg)

    def trends(self, keys: list[str] | None = None) -> DataFrame:
        return metrics.metric_trends(self.merged(), self.cfg, keys)

    def summary(self, keys: list[str] | None = None) -> DataFrame:
        return metrics.metric_report(self.merged(), self.cfg, keys)

    def report(self, project: str, keys: list[str] | None = None, match: str = "like") -> dict[str, DataFrame]:
        return report_tables(self.merged(), project, self.cfg, keys, match)

    def audit(self) -> DataFrame:
        """The refresh log; empty before the first build."""
        return audit_log(self.table).read() if self.table.exists() else self.spark.createDataFrame([], audit.AUDIT_SCHEMA)

    def freshness(self) -> DataFrame:
        return audit.freshness(self.audit())

    def export_csv(self, project: str, folder: str, match: str = "like") -> str | None:
        return export.export_project_csv(self.merged(), project, folder, match)

    def export_all_csv(self, folder: str) -> str:
        return export.export_all_csv(self.merged(), folder)

    # --- upkeep ---------------------------------------------------------------

    def vacuum(self, keep: int = 2, grace: float = GRACE_SECONDS) -> int:
        """Delete data of the table and of the copies that none of the newest ``keep`` states shows."""
        copies = [self.working(s).location for s in self.sources if not s.immutable]
        return self.table.vacuum(keep, grace) + sum(vacuum_snapshot(self.spark, c, keep, grace) for c in copies)
