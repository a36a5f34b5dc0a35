"""Trends after an upsert, from the trends before it.

A changed run moves the rolling values of itself and of the runs after it, as far as the frame reaches; nothing else in its
project and metric changes, as long as there are enough runs for a rolling trend before and after. Where there are not, the group is so
small that all of it is computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.operators import metrics
from runledger.operators.merge import PROJECT_ID
from runledger.operators.metrics import GROUP, METRIC, ORDER, VALUE

#: What tells a trend row from others; rows that agree in all of it are alike.
IDENTITY = [PROJECT_ID, METRIC, "DateTime", "Name", VALUE]


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of all columns, NULL being equal to NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def changed_trends(
    merged: DataFrame, before: DataFrame, after: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None
) -> DataFrame:
    """Trend rows to put in the place of those of ``replaced``.

    ``merged`` is the table after the upsert, ``before`` the rows that it replaced and ``after`` those that it brought, both as rows of the
    merged table. Only the projects of these rows are read, and rolling values are computed only for the runs whose frame has changed.
    """
    chosen = metrics.resolve_metrics(merged, cfg, keys)
    long = lambda df: metrics.trend_points(df, chosen)
    old, new = long(before), long(after)
    groups = old.select(*GROUP).unionByName(new.select(*GROUP)).distinct()
    projects = groups.select(PROJECT_ID).distinct()
    here = merged.join(projects, same(merged, projects, [PROJECT_ID]), "left_semi")
    rows = long(here)
    rows = rows.join(groups, same(rows, groups, GROUP), "left_semi")

    # Marks stand where a run was or is now, before the run of the same place.
    mark = lambda df, kind: df.withColumns({"_real": F.lit(0), "_kind": F.lit(kind)})
    both = rows.withColumns({"_real": F.lit(1), "_kind": F.lit("run")}).unionByName(mark(old, "old")).unionByName(mark(new, "new"))
    place = [F.col(c).asc_nulls_last() for c in ORDER]
    upto = Window.partitionBy(*GROUP).orderBy(*place, "_real").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*GROUP)
    count = lambda kind: F.count_if(F.col("_kind") == kind).over(whole)
    placed = both.withColumn("_pos", F.sum("_real").over(upto)).withColumns({
        "_mark": F.max(F.when(F.col("_real") == 0, F.col("_pos"))).over(upto), "n": count("run"), "_n_before": count("run") - count("new") + count("old")})
    small = (F.col("n") < cfg.rolling_threshold) | (F.col("_n_before") < cfg.rolling_threshold)
    # A new run stands one place behind its mark and reaches width - 1 places on.
    hit = small | (F.col("_pos") - F.col("_mark") <= cfg.rolling_width)
    alike = Window.partitionBy(*GROUP, *ORDER)
    runs = placed.where("_real = 1").withColumn("_hit", F.max(F.coalesce(hit, F.lit(False))).over(alike))
    ahead = Window.partitionBy(*GROUP).orderBy("_pos").rowsBetween(0, cfg.rolling_width - 1)
    needed = runs.withColumn("_needed", F.max("_hit").over(ahead)).where("_needed")
    # The frame of a changed run lies wholly within what is left.
    found = metrics.with_trends(needed, cfg, Window.partitionBy(*GROUP).orderBy("_pos"), whole).where("_hit")
    return metrics.as_series(found)


def replaced(before: DataFrame, put_in: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """IDENTITY of the trend rows that are gone: those of the runs replaced, and those that ``put_in`` states anew."""
    old = metrics.as_named(metrics.trend_points(before, metrics.resolve_metrics(before, cfg, keys)))
    return old.select(*IDENTITY).unionByName(put_in.select(*IDENTITY)).distinct()
