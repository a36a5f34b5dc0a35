"""CSV exports of merged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.merge import PROJECT_ID
from runledger.operators.projects import project_slice, time_order


def export_project_csv(merged: DataFrame, project: str, folder: str, match: str = "like") -> str | None:
    """All rows of a project in time order, with header, to ``<project>_ProjectData.csv``.

    The result is a folder of CSV files whose names follow the time order: large
    projects are written by many tasks. Nothing is written for an empty project.
    """
    rows = project_slice(merged, project, match)
    if rows.isEmpty():
        return None
    path = f"{folder.rstrip('/')}/{project}_ProjectData.csv"
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_all_csv(merged: DataFrame, folder: str) -> str:
    """Every project to its own folder ``project=<id>``, in time order, with all columns in the files.

    Folder names put ``id:`` before the project, so that an empty one is told from a missing one (``none``).
    Ranges are cut over project and time, so one large project is spread over tasks.
    """
    order = [F.col(PROJECT_ID).asc(), *time_order()]
    name = F.coalesce(F.concat(F.lit("id:"), F.col(PROJECT_ID)), F.lit("none"))
    (
        merged.repartitionByRange(*order).withColumn("project", name).sortWithinPartitions("project", *order)
        .write.mode("overwrite").option("header", True).partitionBy("project").csv(folder)
    )
    return folder
