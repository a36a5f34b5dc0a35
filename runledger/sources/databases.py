"""Source databases: named sets of tables in any format Spark reads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import quoted
from runledger.sources import files, sqlite

FILE_FORMATS = ("parquet", "orc", "csv", "json")
SNAPSHOT = "snapshot"
LANDED = "landed"


@dataclass(frozen=True)
class SourceDatabase:
    """Where a set of tables lies.

    =========== ===================================================== =============
    format      location                                              copied by sync
    =========== ===================================================== =============
    parquet ..  folder with one folder or file per table              yes
    sqlite      a SQLite file on a shared path                        yes
    jdbc        a JDBC url; ``options`` hold driver, partitioning     yes
    catalog     a schema of the session catalog                       yes
    snapshot    folder written by ``sync_sources``                    no
    landed      landing folder of immutable versions, see streaming   no
    =========== ===================================================== =============
    """

    name: str
    location: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        known = (*FILE_FORMATS, "sqlite", "jdbc", "catalog", SNAPSHOT, LANDED)
        if self.format not in known:
            raise ValueError(f"unknown format {self.format!r}; known: {known}")

    @property
    def immutable(self) -> bool:
        return self.format in (SNAPSHOT, LANDED)

    def exists(self, spark: SparkSession) -> bool:
        if self.format == "jdbc":
            return True
        if self.format == "catalog":
            return spark.catalog.databaseExists(self.location)
        if self.format == LANDED:
            return self._version(spark) is not None
        return files.exists(spark, self.location)

    def _version(self, spark: SparkSession) -> str | None:
        """Newest version whose marker has been set."""
        versions = [v for v in files.children(spark, f"{self.location}/markers/{self.name}") if v.isdigit()]
        return max(versions, key=int) if versions else None

    def _folder(self, spark: SparkSession) -> str:
        if self.format == LANDED:
            return f"{self.location}/data/{self.name}/{self._version(spark)}"
        return self.location

    def _table_files(self, spark: SparkSession) -> dict[str, str]:
        found = {}
        for entry in files.children(spark, self._folder(spark)):
            stem, dot, extension = entry.rpartition(".")
            found[stem if dot and extension in FILE_FORMATS else entry] = f"{self._folder(spark)}/{entry}"
        return found

    def _snapshot_tables(self, spark: SparkSession) -> dict[str, str]:
        latest = files.Manifests(spark, self.location).latest()
        return {t: f"{self.location}/{part}" for t, part in latest[1]["tables"].items()} if latest else {}

    def version(self, spark: SparkSession) -> str | None:
        """Newest version of an immutable source; None for others, which have no versions."""
        if self.format == LANDED:
            return self._version(spark)
        if self.format == SNAPSHOT:
            numbers = files.Manifests(spark, self.location).numbers()
            return str(numbers[-1]) if numbers else None
        return None

    def pinned(self, spark: SparkSession, version: str | None = None) -> "SourceDatabase | PinnedSource":
        """The source at one version, by default the newest, whatever lands later. Sources without versions are themselves."""
        version = version or self.version(spark)
        if version is None:
            return self
        if self.format == SNAPSHOT:
            found = files.Manifests(spark, self.location).read(int(version))["tables"]
            return PinnedSource(self.name, version, {t: f"{self.location}/{part}" for t, part in found.items()})
        folder = f"{self.location}/data/{self.name}/{version}"
        return PinnedSource(self.name, version, {t: f"{folder}/{t}" for t in files.children(spark, folder)})

    def tables(self, spark: SparkSession) -> list[str]:
        """Table names. A JDBC source names its tables in the option ``tables``."""
        if self.format == "sqlite":
            return sqlite.list_tables(self.location)
        if self.format == "catalog":
            return sorted(t.name for t in spark.catalog.listTables(self.location))
        if self.format == "jdbc":
            return [t for t in self.options.get("tables", "").split(",") if t]
        if self.format == SNAPSHOT:
            return sorted(self._snapshot_tables(spark))
        return sorted(self._table_files(spark))

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if self.format == "sqlite":
            return sqlite.read_sqlite(spark, self.location, table, **self.options)
        if self.format == "catalog":
            return spark.table(".".join(quoted(part) for part in (*self.location.split("."), table)))
        if self.format == "jdbc":
            options = {k: v for k, v in self.options.items() if k != "tables"}
            return spark.read.format("jdbc").options(url=self.location, dbtable=table, **options).load()
        found = self._snapshot_tables(spark) if self.format == SNAPSHOT else self._table_files(spark)
        if table not in found:
            raise ValueError(f"{self.name} has no table {table!r}; found {sorted(found)}")
        kind = "parquet" if self.immutable else self.format
        return spark.read.format(kind).options(**self.options).load(found[table])


@dataclass(frozen=True)
class PinnedSource:
    """One version of a landed source or a snapshot: paths of its parquet tables."""

    name: str
    version: str
    paths: Mapping[str, str]

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if table not in self.paths:
            raise ValueError(f"{self.name} has no table {table!r}; found {sorted(self.paths)}")
        return spark.read.parquet(self.paths[table])


OK, ABSENT, UNREADABLE, MISSING = "ok", "absent", "unreadable", "missing"


@dataclass(frozen=True)
class Outcome:
    """What a check of a source found: the state of each required table, and why."""

    source: str
    states: Mapping[str, str]
    error: Exception | None = None

    @classmethod
    def of(cls, spark: SparkSession, source: SourceDatabase, required: tuple[str, ...]) -> Outcome:
        if not source.exists(spark):
            lost = FileNotFoundError(f"{source.name} not found at {source.location}; check the source settings")
            return cls(source.name, dict.fromkeys(required, ABSENT), lost)
        try:
            found = source.tables(spark)
        except Exception as e:
            unread = ValueError(f"{source.name} at {source.location} cannot be read: {e}")
            unread.__cause__ = e
            return cls(source.name, dict.fromkeys(required, UNREADABLE), unread)
        states = {t: OK if t in found else MISSING for t in required}
        lacking = [t for t in required if t not in found]
        return cls(source.name, states, ValueError(
            f"{source.name} lacks required tables {lacking}; found {found}, required {list(required)}, at {source.location}") if lacking else None)


def validate_source(spark: SparkSession, source: SourceDatabase, required: tuple[str, ...]) -> None:
    """Fail unless the source is there and has all required tables."""
    if error := Outcome.of(spark, source, required).error:
        raise error


def validation_outcomes(
    spark: SparkSession, cfg: LedgerConfig, reports: list[SourceDatabase], metadata: SourceDatabase | None = None
) -> DataFrame:
    """source, table, state, n_rows, error: one row for every required table of every source, and nothing raised.

    ``n_rows`` counts the table where it is there; all tables are counted by one job.
    """
    asked = [(s, cfg.report_tables) for s in reports] + ([(metadata, cfg.metadata_tables)] if metadata else [])
    rows, counts = [], []
    for source, required in asked:
        outcome = Outcome.of(spark, source, required)
        for table, state in outcome.states.items():
            rows.append((source.name, table, state, str(outcome.error) if outcome.error else None))
            if state == OK:
                counted = source.read(spark, table).agg(F.count("*").alias("n_rows"))
                counts.append(counted.select(F.lit(source.name).alias("source"), F.lit(table).alias("table"), "n_rows"))
    told = spark.createDataFrame(rows, "source string, table string, state string, error string")
    if not counts:
        return told.select("source", "table", "state", F.lit(None).cast("bigint").alias("n_rows"), "error")
    return told.join(reduce(lambda a, b: a.unionByName(b), counts), ["source", "table"], "left").select("source", "table", "state", "n_rows", "error")


def validate_sources(
    spark: SparkSession, cfg: LedgerConfig,
    reports: SourceDatabase | list[SourceDatabase] | None = None, metadata: SourceDatabase | None = None,
) -> None:
    """Check every given source; nothing given is nothing to check."""
    if isinstance(reports, SourceDatabase):
        reports = [reports]
    for source in reports or []:
        validate_source(spark, source, cfg.report_tables)
    if metadata is not None:
        validate_source(spark, metadata, cfg.metadata_tables)


def read_reports(spark: SparkSession, sources: list[SourceDatabase], cfg: LedgerConfig) -> list[DataFrame]:
    return [s.read(spark, cfg.report_tables[0]) for s in sources]


def read_project_meta(spark: SparkSession, source: SourceDatabase, cfg: LedgerConfig) -> DataFrame:
    return source.read(spark, cfg.metadata_tables[0])


def read_sample_meta(spark: SparkSession, source: SourceDatabase, cfg: LedgerConfig) -> DataFrame:
    return source.read(spark, cfg.metadata_tables[1])


def _mtime(spark: SparkSession, source: SourceDatabase):
    """Newest change of any file of a source. Only the listing is read, one row per
    file, as the content column is pruned."""
    if source.format in ("jdbc", "catalog"):
        return None
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source._folder(spark))
        return listing.agg(F.max("modificationTime").cast("timestamp_ntz")).first()[0]
    except (PySparkException, Py4JJavaError):
        return None


def fingerprint(spark: SparkSession, source: SourceDatabase) -> str | None:
    """Changes when a file of the source is added, removed, resized or touched. Only the listing is read; None where there is none."""
    if source.format in ("jdbc", "catalog"):
        return None
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source._folder(spark))
        each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        return "-".join(str(v) for v in listing.agg(F.count("*"), F.sum("length"), F.sum(each)).first())
    except (PySparkException, Py4JJavaError):
        return None


def source_bytes(spark: SparkSession, sources: list[SourceDatabase]) -> int:
    """Size of all files of the sources, for ``shuffle_partitions_for``."""
    folders = [s._folder(spark) for s in sources if s.format not in ("jdbc", "catalog")]
    if not folders:
        return 0
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return listing.agg(F.sum("length")).first()[0] or 0


def source_mtimes(spark: SparkSession, sources: list[SourceDatabase]) -> DataFrame:
    """(source, mtime); NULL where it cannot be told."""
    rows = [(s.name, _mtime(spark, s)) for s in sources]
    return spark.createDataFrame(rows, "source string, mtime timestamp_ntz")
