"""The tables behind a project page and its export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.operators import metrics
from runledger.operators.detail import in_first_seen_order, project_detail
from runledger.operators.projects import error_table, project_filter, project_overview, time_order
from runledger.session import materialised


def metric_sections(rows: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """Chosen metrics that have data, in catalogue order, with label and legend texts."""
    return metrics.metric_report(rows, cfg, keys).orderBy("ord")


def report_tables(
    merged: DataFrame, project: str, cfg: LedgerConfig, keys: list[str] | None = None, match: str = "like"
) -> dict[str, DataFrame]:
    """Everything a project page shows, as lazy tables over one stored slice: the table is read once for all of them.

    ``errors`` is empty for a project without failed runs. With ``match="like"``
    a name with wildcards may take in several projects, as one slice.
    """
    rows = project_filter(merged, project, match)
    if match == "like":
        rows = rows.withColumn("ProjectID", F.lit(project))
    rows = materialised(rows)
    long = metrics.metric_long(rows, cfg, keys)
    trends = metrics.metric_trends(rows, cfg, keys)
    return {
        "overview": project_overview(rows, cfg),
        "detail": in_first_seen_order(project_detail(rows, cfg)),
        "errors": error_table(rows.orderBy(*time_order())),
        "metrics": metric_sections(rows, cfg, keys),
        "points": metrics.points(long).orderBy("metric", *time_order()),
        "series": metrics.series_by_type(rows, cfg, keys).orderBy("metric", F.col("first_time").asc_nulls_last(), "first_file"),
        "trends": trends.orderBy("metric", F.col("DateTime").asc_nulls_last(), F.col("Name").asc_nulls_last()),
    }
