"""The registered queries: each operator over the whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions import quoted
from runledger.operators import checks, detail, merge, metrics, projects, recent, reports, upsert
from runledger.plans.fixtures import EVENT_CONFIG, EventSources
from runledger.ledger import Ledger
from runledger.plans import refresh
from runledger.plans.reports import report_tables
from runledger.session import ensure_checkpoint_dir, materialised
from runledger.sources import audit, databases, export, files
from runledger.sources.databases import SourceDatabase
from runledger.sources.store import MergedTable
from runledger.sources.summary import SummaryTable
from runledger.sources.trends import TrendTable
from runledger.streaming import changes
from runledger.streaming.ingest import ingest, start_edit_stream, start_refresh_stream
from runledger.streaming.landing import land_version

CFG = EVENT_CONFIG
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Column names without dots, as the report columns have them."""
    return df.select(*[F.col(quoted(c)).alias(c.replace(".", "_")) for c in df.columns])


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Float results to six places: the order of summation is free."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _sources(spark: SparkSession, sf_dir: str) -> EventSources:
    return EventSources.load(spark, sf_dir)


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    return merge.merge_sources(s.reports, s.sample_meta, s.project_meta, CFG)


def stored_series(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    """The series columns of the merged table, written once for the steps that read them."""
    return materialised(metrics.series_columns(merged_events(spark, sf_dir), CFG, keys))


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.union_reports(_sources(spark, sf_dir).reports, CFG)


# --- merge --------------------------------------------------------------------


@query
def union_reports(spark, sf_dir):
    return plain(_union(spark, sf_dir))


@query
def split_regular_control(spark, sf_dir):
    regular, control = reports.split_regular_control(_union(spark, sf_dir), CFG)
    both = regular.withColumn("is_control", F.lit(False)).unionByName(control.withColumn("is_control", F.lit(True)))
    return both.groupBy("src_idx", "is_control").agg(F.count("*").alias("n"), F.count_distinct("Name").alias("n_names"))


@query
def dedup_regular(spark, sf_dir):
    return plain(reports.dedup_regular(_union(spark, sf_dir), CFG))


@query
def dedup_control(spark, sf_dir):
    return plain(reports.dedup_control(_union(spark, sf_dir), CFG))


@query
def align_control(spark, sf_dir):
    return plain(reports.align_control(_union(spark, sf_dir), CFG)).withColumnRenamed("_key", "RawFileName")


@query
def attach_samples(spark, sf_dir):
    s = _sources(spark, sf_dir)
    aligned = reports.align_control(reports.union_reports(s.reports, CFG), CFG)
    return plain(merge.merge_base(aligned, s.sample_meta, CFG))


@query
def merged(spark, sf_dir):
    return plain(merged_events(spark, sf_dir))


@query
def merged_pattern_standards(spark, sf_dir):
    s = _sources(spark, sf_dir)
    rows = merge.merge_sources(s.reports, s.sample_meta, s.project_meta, CFG.with_(standards_mode="pattern"))
    return rows.groupBy("FileType").agg(F.count("*").alias("n"))


@query
def merge_coverage(spark, sf_dir):
    """How many merged rows each combination of sources contributes, per project."""
    m = merged_events(spark, sf_dir)
    return m.groupBy(
        "ProjectID", F.col("Name").isNotNull().alias("has_regular"), F.col("Name_iQC").isNotNull().alias("has_control"),
        F.col("SampleName_ID").isNotNull().alias("has_sample"), F.col("ProjectName").isNotNull().alias("has_project"),
    ).agg(F.count("*").alias("n"))


@query
def assert_unique_report(spark, sf_dir):
    """Files that would fail a full build, when some samples also have a ``.d`` row."""
    s = _sources(spark, sf_dir)
    twins = s.sample_meta.where(F.col("Error").isNotNull()).withColumn(
        "SampleName_ID", F.regexp_replace("SampleName_ID", r"\.raw\z", ".d"))
    rows = merge.merge_sources(s.reports, s.sample_meta.unionByName(twins), s.project_meta, CFG)
    return checks.duplicate_keys(rows, "RawFileName")


@query
def merged_error_in_projects(spark, sf_dir):
    """The merge when ``Error`` is a column of the project table."""
    s = _sources(spark, sf_dir)
    failed = s.project_meta.withColumn("Error", F.when(F.col("ProjectID").endswith("_B1"), F.lit("broken")))
    return plain(merge.merge_sources(s.reports, s.sample_meta.drop("Error"), failed, CFG))


# --- stored tables --------------------------------------------------------------


def _stored(spark: SparkSession, name: str, build: Callable[[str], DataFrame]) -> DataFrame:
    """What ``build`` makes in a folder of its own below the shared checkpoint folder, which goes afterwards."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/{name}/{uuid.uuid4().hex}"
    try:
        return materialised(build(root))
    finally:
        files.remove_tree(spark, root)


def _tables(s: EventSources) -> dict[str, dict[str, DataFrame]]:
    return {"ra": {"SingleFileReport": s.report_a}, "rb": {"SingleFileReport": s.report_b},
            "meta": {"Metadata_Sample": s.sample_meta, "Metadata_Project": s.project_meta}}


def _earlier(s: EventSources) -> EventSources:
    """The sources before every sixth run was there, with other values of one metric."""
    return EventSources(s.events.where("event_id % 6 != 0").withColumn("value", F.lit(0.0)))


def _landed_ledger(spark: SparkSession, root: str) -> Ledger:
    source = lambda n: SourceDatabase(n, f"{root}/landing", "landed")
    return Ledger(spark, f"{root}/ledger", [source("ra"), source("rb")], source("meta"), CFG)


def _land(spark: SparkSession, root: str, version: int, s: EventSources) -> None:
    for name, tables in _tables(s).items():
        land_version(spark, f"{root}/landing", name, version, tables)


@query
def full_refresh_stored(spark, sf_dir):
    """Sources as parquet folders, checked, copied and built into a stored table."""
    def build(root: str) -> DataFrame:
        for name, tables in _tables(_sources(spark, sf_dir)).items():
            for table, df in tables.items():
                df.write.parquet(f"{root}/in/{name}/{table}")
        source = lambda n: SourceDatabase(n, f"{root}/in/{n}")
        ledger = Ledger(spark, f"{root}/ledger", [source("ra"), source("rb")], source("meta"), CFG)
        ledger.bootstrap()
        return ledger.merged()

    return plain(_stored(spark, "full", build))


@query
def incremental_all_changes(spark, sf_dir):
    """One refresh after a version in which every run changed or is new takes all of them."""
    def build(root: str) -> DataFrame:
        s, ledger = _sources(spark, sf_dir), _landed_ledger(spark, root)
        _land(spark, root, 1, _earlier(s))
        ledger.bootstrap()
        _land(spark, root, 2, s)
        ledger.refresh()
        return ledger.merged()

    return plain(_stored(spark, "incremental", build))


@query
def stream_refresh_stored(spark, sf_dir):
    """The same change taken by the stream over the landing folder."""
    def build(root: str) -> DataFrame:
        s, ledger = _sources(spark, sf_dir), _landed_ledger(spark, root)
        _land(spark, root, 1, _earlier(s))
        ingest(ledger, f"{root}/landing", f"{root}/stream", available_now=True).awaitTermination()
        _land(spark, root, 2, s)
        start_refresh_stream(ledger, f"{root}/landing", f"{root}/stream", available_now=True).awaitTermination()
        return ledger.merged()

    return plain(_stored(spark, "stream", build))


@query
def validation_outcomes(spark, sf_dir):
    """A complete source, one without its table, metadata of which one table is missing, and a source that is not there."""
    def build(root: str) -> DataFrame:
        t = _tables(_sources(spark, sf_dir))
        t["ra"]["SingleFileReport"].write.parquet(f"{root}/in/ra/SingleFileReport")
        t["rb"]["SingleFileReport"].write.parquet(f"{root}/in/rb/OtherReport")
        t["meta"]["Metadata_Sample"].write.parquet(f"{root}/in/meta/Metadata_Sample")
        source = lambda n: SourceDatabase(n, f"{root}/in/{n}")
        found = databases.validation_outcomes(spark, CFG, [source("ra"), source("rb"), source("rc")], source("meta"))
        return found.select("source", "table", "state", "n_rows", F.col("error").isNotNull().alias("failed"))

    return _stored(spark, "validation", build)


@query
def audit_history(spark, sf_dir):
    """The log of a build and two refreshes, the last step of which is replayed."""
    def build(root: str) -> DataFrame:
        s, ledger = _sources(spark, sf_dir), _landed_ledger(spark, root)
        _land(spark, root, 1, _earlier(s))
        ledger.bootstrap()
        _land(spark, root, 2, EventSources(s.events.where("event_id % 12 != 0")))
        ledger.refresh(step=("stream", 0))
        _land(spark, root, 3, s)
        ledger.refresh(step=("stream", 1))
        ledger.refresh(step=("stream", 1))
        in_time = Window.orderBy("updated_at", "row_count")  # one row for each refresh
        names = F.map_keys(F.from_json("source_mtimes", "map<string,string>"))
        return ledger.audit().select(
            F.row_number().over(in_time).cast("bigint").alias("refresh"), "row_count", (F.col("row_count") - F.lag("row_count").over(in_time)).alias("gained"),
            F.array_join(F.sort_array(names), ",").alias("sources"))

    return _stored(spark, "audit", build)


@query
def report_tables_all(spark, sf_dir):
    """The tables of a project page by their sizes and a sum over each."""
    tables = report_tables(materialised(merged_events(spark, sf_dir)), "P1_click_B1", CFG, match="exact")
    sums = {"overview": "n_valid", "detail": "n_runs", "errors": "1", "metrics": "n_points", "points": "value", "series": "n_points", "trends": "Median"}
    parts = [tables[name].agg(F.count("*").alias("n"), F.round(F.sum(F.expr(what).cast("double")), 6).alias("total")).select(F.lit(name).alias("section"), "n", "total")
             for name, what in sums.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def edited_sources_stored(spark, sf_dir):
    """Sources written over in place, found by the stream over listings, and taken by one refresh."""
    def build(root: str) -> DataFrame:
        def write(s: EventSources) -> None:
            for name, tables in _tables(s).items():
                for table, df in tables.items():
                    df.write.mode("overwrite").parquet(f"{root}/in/{name}/{table}")

        s = _sources(spark, sf_dir)
        source = lambda n: SourceDatabase(n, f"{root}/in/{n}")
        ledger = Ledger(spark, f"{root}/ledger", [source("ra"), source("rb")], source("meta"), CFG)
        write(_earlier(s))
        ledger.bootstrap()
        write(s)
        start_edit_stream(ledger, f"{root}/stream", available_now=True).awaitTermination()
        return ledger.merged()

    return plain(_stored(spark, "edited", build))


@query
def upsert_touched_files(spark, sf_dir):
    """One project's runs taken into a stored table of many files; only the files that may hold them are written anew."""
    def build(root: str) -> DataFrame:
        s = _sources(spark, sf_dir)
        table = MergedTable(spark, root, CFG.with_(compact_rows=1))
        table.replace(_stale_target(s), n_files=32)
        part = table.stage(projects.project_filter(merge.merge_sources(s.reports, s.sample_meta, s.project_meta, CFG), "P1_click_B1"))
        given = table.staged(part)
        n = given.count()
        known = table.holding(given.select("RawFileName")).join(given.select("RawFileName"), "RawFileName", "left_semi").count()
        table.upsert(part, n, n - known)
        return table.read()

    return plain(_stored(spark, "touched", build))


def _followed(spark: SparkSession, sf_dir: str, root: str, follower: TrendTable | SummaryTable) -> None:
    """A stored table and what follows it, through upserts of the runs of some projects: new ones, and others with a new value, error or time."""
    now = materialised(merged_events(spark, sf_dir))
    event = F.element_at(F.split("RawFileName", "_"), -1).cast("bigint")
    some = F.col("ProjectID").like("%_B1") & F.col("RawFileName").isNotNull()
    earlier = now.where(F.coalesce(~(some & (event % 6 == 0)), F.lit(True)))
    earlier = earlier.withColumn("m.1", F.when(some & (event % 7 == 0), F.lit(0.0)).otherwise(F.col("`m.1`")))
    earlier = earlier.withColumn("Error", F.when(some & (event % 11 == 0), F.lit("lost")).otherwise(F.col("Error")))
    earlier = earlier.withColumn("DateTime", F.when(some & (event % 13 == 0), F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("DateTime")))
    table = MergedTable(spark, f"{root}/table", CFG)
    table.replace(earlier, n_files=16)
    follower.rebuild(table)
    for k in (6, 7, 11, 13):
        part = table.stage(now.where(some & (event % k == 0)))
        given = table.staged(part)
        n = given.count()
        known = table.rows_of(given.select("RawFileName"), n).count()
        own = {"trends": follower} if isinstance(follower, TrendTable) else {"summary": follower}
        refresh.upsert_with_trends(table, part, n, n - known, **own)


@query
def summary_after_refresh(spark, sf_dir):
    """Stored summaries of the projects after upserts that also take newest runs away; the start page and overview read these alone."""
    def build(root: str) -> DataFrame:
        summary = SummaryTable(spark, f"{root}/summary", CFG)
        _followed(spark, sf_dir, root, summary)
        return summary.read()

    return _stored(spark, "summary", build)


@query
def trends_after_refresh(spark, sf_dir):
    """Stored trends after the same upserts."""
    def build(root: str) -> DataFrame:
        trends = TrendTable(spark, f"{root}/trends", CFG)
        _followed(spark, sf_dir, root, trends)
        return trends.read()

    return rounded(_stored(spark, "trends", build), *_TREND_FLOATS)


@query
def export_roundtrip(spark, sf_dir):
    """All projects exported as CSV and read again, all columns."""
    def build(root: str) -> DataFrame:
        rows = merged_events(spark, sf_dir)
        export.export_all_csv(rows, root)
        back = spark.read.schema(rows.schema).option("header", True).csv(root)
        return back.select(*[quoted(c) for c in rows.columns], F.col("project").alias("folder"))

    return plain(_stored(spark, "export", build))


# --- upsert -------------------------------------------------------------------


@query
def distinct_samples(spark, sf_dir):
    return recent.distinct_samples(_sources(spark, sf_dir).sample_meta)


@query
def recent_samples(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return recent.recent_samples(s.reports, s.sample_meta, CFG.recent_rows, CFG)


def _updates(s: EventSources) -> tuple[DataFrame, DataFrame, int]:
    # A few rows that several steps look at.
    rec = materialised(recent.recent_samples(s.reports, s.sample_meta, CFG.recent_rows, CFG))
    n = CFG.recent_rows * 3
    rows = upsert.dedup_upserts(upsert.recent_merge(s.reports, s.sample_meta, s.project_meta, rec, n, CFG))
    return rec, materialised(rows), n


def _stale_target(s: EventSources) -> DataFrame:
    """The merged table with every sixth run missing and one metric zeroed."""
    rows = merge.merge_sources(s.reports, s.sample_meta, s.project_meta, CFG)
    event = F.element_at(F.split("RawFileName", "_"), -1).cast("bigint")
    return rows.where(event % 6 != 0).withColumn("m.1", F.lit(0.0))


@query
def recent_merge(spark, sf_dir):
    _, rows, _ = _updates(_sources(spark, sf_dir))
    return plain(rows)


@query
def recent_semi(spark, sf_dir):
    s = _sources(spark, sf_dir)
    rec = recent.recent_samples(s.reports, s.sample_meta, CFG.recent_rows, CFG)
    rows = upsert.recent_semi(_stale_target(s), rec)
    return rows.select("RawFileName", "ProjectID", "DateTime")


@query
def upsert_result(spark, sf_dir):
    s = _sources(spark, sf_dir)
    _, rows, n = _updates(s)
    return plain(upsert.merge_upsert(_stale_target(s), rows, n, CFG))


@query
def refresh_counts(spark, sf_dir):
    s = _sources(spark, sf_dir)
    rec, rows, n = _updates(s)
    return upsert.refresh_counts(_stale_target(s), rows, rec, n, CFG)


# --- projects -----------------------------------------------------------------


@query
def project_slice_like(spark, sf_dir):
    return plain(projects.project_slice(merged_events(spark, sf_dir), "P1_click_B_", "like"))


@query
def project_slice_exact(spark, sf_dir):
    return plain(projects.project_slice(merged_events(spark, sf_dir), "P4_view_B1", "exact"))


@query
def valid_error_split(spark, sf_dir):
    valid, failed = projects.split_valid_error(merged_events(spark, sf_dir))
    both = valid.withColumn("is_error", F.lit(False)).unionByName(failed.withColumn("is_error", F.lit(True)))
    return both.select("ProjectID", "RawFileName", "Date", "Error", "is_error")


@query
def error_table(spark, sf_dir):
    return projects.error_table(merged_events(spark, sf_dir))


@query
def projects_by_recency(spark, sf_dir):
    return projects.projects_by_recency(merged_events(spark, sf_dir))


@query
def search_projects(spark, sf_dir):
    return projects.search_projects(merged_events(spark, sf_dir), "CLICK_b", 10)


@query
def project_page(spark, sf_dir):
    return projects.project_page(merged_events(spark, sf_dir), 20)


@query
def last_measured(spark, sf_dir):
    return projects.last_measured(merged_events(spark, sf_dir))


@query
def project_overview(spark, sf_dir):
    return projects.project_overview(merged_events(spark, sf_dir), CFG)


@query
def project_detail(spark, sf_dir):
    return detail.project_detail(merged_events(spark, sf_dir), CFG)


# --- metrics ------------------------------------------------------------------


@query
def metric_long(spark, sf_dir):
    return metrics.metric_long(merged_events(spark, sf_dir), CFG)


@query
def points(spark, sf_dir):
    """Points of two chosen metrics, with label and position in the catalogue."""
    long = metrics.metric_long(merged_events(spark, sf_dir), CFG, ["m1", "m2_iQC"])
    labels = metrics.metric_labels(spark, CFG).drop("column")
    return metrics.points(long).join(F.broadcast(labels), "metric").withColumn("ord", F.col("ord").cast("bigint"))


@query
def series_by_type(spark, sf_dir):
    return metrics.series_by_type(merged_events(spark, sf_dir), CFG)


@query
def exclude_standards(spark, sf_dir):
    rows = metrics.exclude_standards(metrics.metric_long(merged_events(spark, sf_dir), CFG))
    return rows.groupBy("metric", "FileType").agg(F.count("*").alias("n"))


@query
def trend_mode(spark, sf_dir):
    return metrics.trend_mode(merged_events(spark, sf_dir), CFG)


@query
def metric_availability(spark, sf_dir):
    return metrics.metric_availability(merged_events(spark, sf_dir), CFG)


_TREND_FLOATS = ("Median", "std", "Lower", "Upper")


@query
def metric_trends(spark, sf_dir):
    return rounded(metrics.metric_trends(stored_series(spark, sf_dir), CFG), *_TREND_FLOATS)


@query
def rolling_trend(spark, sf_dir):
    return rounded(metrics.rolling_trend(stored_series(spark, sf_dir), CFG), *_TREND_FLOATS)


@query
def static_trend(spark, sf_dir):
    return rounded(metrics.static_trend(stored_series(spark, sf_dir), CFG), *_TREND_FLOATS)


@query
def metric_summary(spark, sf_dir):
    return rounded(metrics.metric_summary(stored_series(spark, sf_dir), CFG), "mean", "median", "std")


@query
def metric_report(spark, sf_dir):
    rows = metrics.metric_report(stored_series(spark, sf_dir), CFG)
    # Sums are free in their order, so a mean that lies on a tie of the second decimal may fall to either side.
    texts = {f"{c}_text": F.when(F.abs(F.pmod(F.col(c) * 100, F.lit(1.0)) - 0.5) > 1e-6, F.col(f"{c}_text")) for c in ("mean", "median", "std")}
    return rounded(rows.withColumns(texts), "mean", "median", "std").withColumn("ord", F.col("ord").cast("bigint"))


@query
def summary_texts(spark, sf_dir):
    """Legend texts of the largest and smallest value of every metric, as stored."""
    rows = metrics.metric_long(merged_events(spark, sf_dir), CFG)
    ends = rows.groupBy("ProjectID", "metric").agg(F.max("value").alias("hi"), F.min(F.col("value") / 7 - 50).alias("lo"))
    text = metrics.summary_text
    return ends.select("ProjectID", "metric", text("mean", F.col("hi")).alias("mean_text"), text("std dev", F.col("lo")).alias("std_text"))


# --- audit and changes ----------------------------------------------------------


def _audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refresh per day of events: its last time and the rows known by then."""
    days = _sources(spark, sf_dir).events.groupBy(F.to_date("ts").alias("day")).agg(
        F.max("ts").alias("updated_at"), F.count("*").alias("n"))
    # One row per calendar day, whatever the number of events.
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("updated_at", F.lit("{}").alias("source_mtimes"), F.sum("n").over(so_far).alias("row_count"))


@query
def latest_refresh(spark, sf_dir):
    return audit.latest_refresh(_audit_rows(spark, sf_dir))


@query
def freshness(spark, sf_dir):
    return audit.freshness(_audit_rows(spark, sf_dir))


@query
def mtimes_json(spark, sf_dir):
    """Newest event per kind in the role of source change times; one source is unreadable."""
    newest = _sources(spark, sf_dir).events.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("mtime"))
    return audit.mtimes_json(newest.withColumn("mtime", F.when(F.col("source") != "signup", F.col("mtime"))))


@query
def route_changes(spark, sf_dir):
    """Changed paths of all events against a registry of three known sources."""
    paths = _sources(spark, sf_dir).events.select(F.concat(F.lit("/ext/"), F.col("event_type"), F.lit(".sqlite")).alias("path"))
    registry = changes.registry_frame(spark, {
        "/ext/click.sqlite": ("click", changes.REPORT),
        "/ext/view.sqlite": ("view", changes.REPORT),
        "/ext/error.sqlite": ("meta", changes.METADATA)})
    return changes.route_changes(paths, registry)
