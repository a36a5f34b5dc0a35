"""Metric series: points, trends and summaries of all projects and metrics at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.config import LedgerConfig, Metric
from runledger.functions import quoted, summary_text, to_number
from runledger.functions.names import HS_STANDARD, OTHER_STANDARD
from runledger.operators.merge import ERROR, PROJECT_ID, RAW_FILE
from runledger.operators.projects import split_valid_error
from runledger.operators.selection import medians
from runledger.operators.skew import CHUNK, hot_groups, ordered_chunks, split_by

METRIC = "metric"
VALUE = "value"
GROUP = [PROJECT_ID, METRIC]
ROLLING, STATIC, NONE = "rolling", "static", "none"


def resolve_metrics(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> list[Metric]:
    """Catalogue entries in catalogue order: the chosen ones whose column exists."""
    if keys is not None:
        for key in keys:
            cfg.metric(key)
    have = set(merged.columns)
    return [m for m in cfg.metrics if (keys is None or m.key in keys) and m.merged_column in have]


def series_columns(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """Only the columns that series, trends and summaries read."""
    wanted = dict.fromkeys([
        PROJECT_ID, "DateTime", RAW_FILE, "FileType", "Date", ERROR, *(m.merged_column for m in resolve_metrics(merged, cfg, keys))])
    return merged.select(*[quoted(c) for c in wanted])


def metric_labels(spark, cfg: LedgerConfig) -> DataFrame:
    """The catalogue as a table: key, merged column, label and position."""
    rows = [(m.key, m.merged_column, m.label, i) for i, m in enumerate(cfg.metrics)]
    return spark.createDataFrame(rows, f"{METRIC} string, column string, label string, ord int")


def is_standard() -> Column:
    """Standards are left out of trends. A run without a type is none."""
    return F.coalesce(F.col("FileType").isin(HS_STANDARD, OTHER_STANDARD), F.lit(False))


def exclude_standards(rows: DataFrame) -> DataFrame:
    return rows.where(~is_standard())


def _numbers(merged: DataFrame, metrics: list[Metric]) -> list[Column]:
    schema = merged.schema
    return [to_number(F.col(quoted(m.merged_column)), schema[m.merged_column].dataType).alias(m.key) for m in metrics]


_IDS = [PROJECT_ID, "DateTime", RAW_FILE, "FileType"]


def _wide(merged: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Valid runs with one numeric column per metric."""
    valid, _ = split_valid_error(merged)
    return valid.select(*_IDS, *_numbers(merged, metrics))


def _stack(wide: DataFrame, metrics: list[Metric]) -> DataFrame:
    """One row per run and metric with a number. A generator keeps the partitioning
    of its input, which the unpivot operator would not."""
    if not metrics:
        return wide.limit(0).select(PROJECT_ID, F.lit("").alias(METRIC), *_IDS[1:], F.lit(None).cast("double").alias(VALUE))
    cells = F.array(*[F.struct(F.lit(m.key).alias(METRIC), F.col(quoted(m.key)).alias(VALUE)) for m in metrics])
    return (
        wide.select(*_IDS, F.inline(cells)).where(F.col(VALUE).isNotNull())
        .select(PROJECT_ID, METRIC, *_IDS[1:], VALUE)
    )


def metric_long(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """Valid runs, one row per run and metric with a number."""
    metrics = resolve_metrics(merged, cfg, keys)
    return _stack(_wide(merged, metrics), metrics)


def points(long: DataFrame) -> DataFrame:
    """The measured points, standards included."""
    return long.select(PROJECT_ID, METRIC, "DateTime", VALUE, "FileType", RAW_FILE)


def _stack_groups(groups: DataFrame, keys: list[str], metrics: list[Metric], fields: dict[str, str]) -> DataFrame:
    """Turn per-metric results, columns ``<prefix><i>``, into one row per group and metric."""
    entries = F.array(*[
        F.struct(F.lit(m.key).alias(METRIC), *[F.col(f"{prefix}{i}").alias(name) for name, prefix in fields.items()])
        for i, m in enumerate(metrics)
    ])
    return groups.select(*keys, F.inline(entries))


def series_by_type(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """The point series of each metric, one per file type, with the run each starts at.

    Series are drawn in the order of their first run. Runs without a type have no
    series. Aggregated on the wide rows, one column set per metric, then stacked.
    """
    metrics = resolve_metrics(merged, cfg, keys)
    wide = _wide(merged, metrics).where(F.col("FileType").isNotNull())
    run = F.struct(F.col("DateTime").isNull().alias("no_time"), "DateTime", RAW_FILE)
    aggs = []
    for i, m in enumerate(metrics):
        present = F.col(quoted(m.key)).isNotNull()
        aggs += [F.count_if(present).alias(f"_n{i}"), F.min(F.when(present, run)).alias(f"_f{i}")]
    if not aggs:
        return wide.limit(0).select(
            PROJECT_ID, F.lit("").alias(METRIC), "FileType", F.lit(0).cast("bigint").alias("n_points"),
            F.col("DateTime").alias("first_time"), F.col(RAW_FILE).alias("first_file"))
    groups = wide.groupBy(PROJECT_ID, "FileType").agg(*aggs)
    return (
        _stack_groups(groups, [PROJECT_ID, "FileType"], metrics, {"n_points": "_n", "_first": "_f"})
        .where("n_points > 0")
        .select(
            *GROUP, "FileType", "n_points",
            F.col("_first")["DateTime"].alias("first_time"), F.col("_first")[RAW_FILE].alias("first_file"),
        )
    )


def mode_of(n: Column, cfg: LedgerConfig) -> Column:
    return (
        F.when(n >= cfg.rolling_threshold, F.lit(ROLLING))
        .when(n > cfg.static_floor, F.lit(STATIC))
        .otherwise(F.lit(NONE))
    )


def metric_counts(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """Numeric runs per project and metric: all of them, and without standards.

    Counted on the wide rows, one column per metric, and turned long after the
    aggregation; the rows are not multiplied by the number of metrics.
    """
    metrics = resolve_metrics(merged, cfg, keys)
    valid, _ = split_valid_error(merged)
    wide = valid.select(PROJECT_ID, is_standard().alias("_std"), *_numbers(merged, metrics))
    aggs = []
    for i, m in enumerate(metrics):
        present = F.col(quoted(m.key)).isNotNull()
        aggs.append(F.count_if(present).alias(f"_p{i}"))
        aggs.append(F.count_if(present & ~F.col("_std")).alias(f"_n{i}"))
    if not aggs:
        return wide.limit(0).select(PROJECT_ID, F.lit("").alias(METRIC), F.lit(0).cast("bigint").alias("n_points"),
                                    F.lit(0).cast("bigint").alias("n"))
    groups = wide.groupBy(PROJECT_ID).agg(*aggs)
    return _stack_groups(groups, [PROJECT_ID], metrics, {"n_points": "_p", "n": "_n"})


def trend_mode(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """Which trend each project and metric gets, by its number of runs without standards."""
    counts = metric_counts(merged, cfg, keys)
    return counts.select(*GROUP, "n", mode_of(F.col("n"), cfg).alias("mode"))


def metric_availability(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """Whether a metric has any number in a project; those without are hidden."""
    counts = metric_counts(merged, cfg, keys)
    return counts.select(*GROUP, "n_points", (F.col("n_points") > 0).alias("available"))


# --- trends -----------------------------------------------------------------

ORDER = ["DateTime", RAW_FILE, VALUE]


def _in_time(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])


def _rolling(window: Window, cfg: LedgerConfig) -> list[Column]:
    """Median and spread of the latest rows; the frame bounds the list that is sorted."""
    frame = window.rowsBetween(1 - cfg.rolling_width, 0)
    return [F.sort_array(F.collect_list(VALUE).over(frame)).alias("_latest"), F.stddev_samp(VALUE).over(frame).alias("std")]


def _middle(values: Column) -> Column:
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(values, low) + F.get(values, high)) / 2


def trend_points(merged: DataFrame, metrics: list[Metric]) -> DataFrame:
    """The points that trends are made of: valid runs with a number, standards left out."""
    return exclude_standards(_stack(_wide(merged, metrics), metrics))


def as_named(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed(RAW_FILE, "Name")


def as_series(rows: DataFrame) -> DataFrame:
    return rows.select(
        *GROUP, "DateTime", VALUE, F.col(RAW_FILE).alias("Name"), "FileType", "mode",
        "Median", "std", (F.col("Median") - F.col("std")).alias("Lower"), (F.col("Median") + F.col("std")).alias("Upper"),
    )


def _trends_per_group(rows: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Trends where one task takes a whole group: one shuffle, one sort."""
    window = _in_time(*GROUP)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return as_series(with_trends(rows.select("*", F.count("*").over(whole).alias("n")), cfg, window, whole))


def with_trends(rows: DataFrame, cfg: LedgerConfig, window: Window, whole: Window) -> DataFrame:
    """``rows`` with ``n`` (runs of the group) and their mode, Median and std; ``window`` has a group in order, ``whole`` all of it."""
    sized = rows.select("*", *_rolling(window, cfg))
    # Only small groups feed the static numbers; the others contribute NULLs.
    small = F.when(F.col("n") < cfg.rolling_threshold, F.col(VALUE))
    both = sized.select(
        "*", F.percentile(small, 0.5).over(whole).alias("_static_median"), F.stddev_samp(small).over(whole).alias("_static_std"),
        mode_of(F.col("n"), cfg).alias("mode"),
    )
    rolling = F.col("mode") == ROLLING
    static = F.col("mode") == STATIC
    return both.withColumns({
        "Median": F.when(rolling, _middle(F.col("_latest"))).when(static, F.col("_static_median")),
        "std": F.when(rolling, F.col("std")).when(static, F.col("_static_std")),
    })


def _rolling_in_chunks(rows: DataFrame, total: int, cfg: LedgerConfig) -> DataFrame:
    """Rolling trends of groups that are cut over several tasks.

    Inside a chunk all but the first rows have their whole frame at hand. The
    first rows of each chunk need the last rows of the chunks before: those few
    rows at the chunk edges, put together in order, give exactly their frames.
    """
    reach = cfg.rolling_width - 1
    order = [F.col(c).asc_nulls_last() for c in [*GROUP, *ORDER]]
    chunks = ordered_chunks(rows, order, total, cfg)
    window = _in_time(*GROUP, CHUNK)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = chunks.select("*", F.row_number().over(window).alias("_pos"), F.count("*").over(whole).alias("_size"))
    inner = placed.select("*", *_rolling(window, cfg)).where(F.col("_pos") > reach)
    edges = placed.where((F.col("_pos") <= reach) | (F.col("_pos") > F.col("_size") - reach))
    in_order = Window.partitionBy(*GROUP).orderBy(CHUNK, "_pos")
    heads = edges.select("*", *_rolling(in_order, cfg)).where(F.col("_pos") <= reach)
    return as_series(
        inner.unionByName(heads)
        .withColumns({"Median": _middle(F.col("_latest")), "mode": F.lit(ROLLING)})
    )


def metric_trends(
    merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None
) -> DataFrame:
    """Trend rows of every project and metric, standards left out.

    ``rolling``: median and spread over the latest rows. ``static``: those of the
    whole group on each row. ``none``: too few rows, no trend values.
    """
    metrics = resolve_metrics(merged, cfg, keys)
    wide = exclude_standards(_wide(merged, metrics))

    def whole_projects(df: DataFrame) -> DataFrame:
        # Shuffled by project while a run is still one row, then stacked: the windows
        # need no second shuffle, and names and times travel once, not per metric.
        return _trends_per_group(_stack(df.repartition(PROJECT_ID), metrics), cfg)

    counts = metric_counts(merged, cfg, keys)
    # A group with a static or no trend is never split, however small the limit.
    hot = hot_groups(merged, counts.where(F.col("n") >= cfg.rolling_threshold), GROUP, cfg, "n")
    if hot is None:
        return whole_projects(wide)
    total = hot.agg(F.sum("n")).first()[0]
    cold, warm = split_by(wide, hot.select(PROJECT_ID).distinct(), [PROJECT_ID])
    small, large = split_by(_stack(warm, metrics), hot, GROUP)
    return (
        whole_projects(cold)
        .unionByName(_trends_per_group(small, cfg))
        .unionByName(_rolling_in_chunks(large, total, cfg))
    )


def rolling_trend(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    return metric_trends(merged, cfg, keys).where(F.col("mode") == ROLLING)


def static_trend(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None) -> DataFrame:
    """One median and band repeated on each row of the smaller groups."""
    return metric_trends(merged, cfg, keys).where(F.col("mode") == STATIC)


# --- summaries ----------------------------------------------------------------


def _flagged(wide: DataFrame, metrics: list[Metric]) -> DataFrame:
    """One row per run and metric with a number, and whether the run is a standard."""
    cells = F.array(*[F.struct(F.lit(m.key).alias(METRIC), F.col(quoted(m.key)).alias(VALUE)) for m in metrics])
    return wide.select(PROJECT_ID, "_std", F.inline(cells)).where(F.col(VALUE).isNotNull())


def _moments() -> list[Column]:
    """Counts, mean and deviation; all but the first without standards."""
    trended = F.when(~F.col("_std"), F.col(VALUE))
    return [F.count("*").alias("n_points"), F.count(trended).alias("n"), F.avg(trended).alias("mean"), F.stddev_samp(trended).alias("std")]


def _ranked(rows: DataFrame) -> DataFrame:
    """Statistics of groups whose rows one task may sort; the sort spills, so nothing of a group's size is held in memory."""
    group = Window.partitionBy(*GROUP)
    n = F.count_if(~F.col("_std")).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.row_number().over(group.orderBy("_std", VALUE))
    # Standards come last, so ranks up to n are those of the others.
    middle = (F.col("_at") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_at") == F.floor((F.col("_n") + 2) / 2))
    value = F.when(middle & ~F.col("_std"), F.col(VALUE))
    placed = rows.select("*", n.alias("_n"), at.alias("_at"))
    return placed.groupBy(*GROUP).agg(*_moments(), (F.min(value) * 0.5 + F.max(value) * 0.5).alias("median"))


def _group_statistics(merged: DataFrame, metrics: list[Metric], hot: DataFrame | None) -> DataFrame:
    """Counts and statistics of every group. Runs are shuffled by project while they are one row; that is the only shuffle
    but for groups in ``hot``, which are summed before theirs and have their medians selected by counting."""
    valid, _ = split_valid_error(merged)
    wide = valid.select(PROJECT_ID, is_standard().alias("_std"), *_numbers(merged, metrics))
    if hot is None:
        return _ranked(_flagged(wide.repartition(PROJECT_ID), metrics))
    cold, warm = split_by(wide, hot.select(PROJECT_ID).distinct(), [PROJECT_ID])
    small, large = split_by(_flagged(warm, metrics), hot, GROUP)
    # One row per hot group: bounded like the list of them.
    middle = F.broadcast(medians(large.where("NOT _std").select(*GROUP, VALUE), hot, GROUP, VALUE))
    many = large.groupBy(*GROUP).agg(*_moments()).join(middle, GROUP, "left")
    return _ranked(_flagged(cold.repartition(PROJECT_ID), metrics)).unionByName(_ranked(small)).unionByName(many)


def _summaries(merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None) -> DataFrame:
    """n_points, n (without standards), mean, median, std of each project and metric with any number; the last three
    only where there are enough runs."""
    metrics = resolve_metrics(merged, cfg, keys)
    if not metrics:
        none = F.lit(None).cast("double")
        return metric_counts(merged, cfg, keys).withColumns({"mean": none, "median": none, "std": none})
    hot = hot_groups(merged, metric_counts(merged, cfg, keys).where("n > 0"), GROUP, cfg, "n")
    enough = F.col("n") > cfg.static_floor
    return _group_statistics(merged, metrics, hot).withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "median", "std")})


def metric_summary(
    merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None
) -> DataFrame:
    """Exact mean, median and sample deviation per project and metric, without standards.

    NULL where there are too few runs. Groups with none do not appear.
    """
    return _summaries(merged, cfg, keys).where("n > 0").select(*GROUP, "n", "mean", "median", "std")


def metric_report(
    merged: DataFrame, cfg: LedgerConfig, keys: list[str] | None = None
) -> DataFrame:
    """Summary of each metric shown for a project, with label, position and legend texts."""
    labels = F.broadcast(metric_labels(merged.sparkSession, cfg).drop("column"))
    shown = _summaries(merged, cfg, keys).withColumnRenamed("n", "n_trend")
    return (
        shown.join(labels, METRIC)
        .select(
            PROJECT_ID, METRIC, "label", "ord", "n_points", "n_trend",
            mode_of(F.col("n_trend"), cfg).alias("mode"), "mean", "median", "std",
            summary_text("mean", F.col("mean")).alias("mean_text"),
            summary_text("median", F.col("median")).alias("median_text"),
            summary_text("std dev", F.col("std")).alias("std_text"),
        )
    )
