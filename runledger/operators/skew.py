"""Splitting of groups that are too large for one task.

Most groups are small and one shuffle on the group key serves them. A group may
also hold a third of all rows; these helpers find such groups and cut them into
ordered chunks, so that no task has to take a whole one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import quoted
from runledger.session import ensure_checkpoint_dir

CHUNK = "_chunk"


def hot_groups(
    rows: DataFrame, counts: DataFrame, keys: list[str], cfg: LedgerConfig, count: str = "count"
) -> DataFrame | None:
    """Groups above the size limit, or None when there are none.

    No group has more members than ``rows`` has rows. Their number, which a stored
    table gives from its footers, often settles the question before any grouping.
    ``counts`` has one row per group. The limit is at least total/max_hot_groups,
    so there are at most ``max_hot_groups`` hot groups whatever the data.
    The answer keeps the column ``count``.
    """
    if rows.count() <= cfg.hot_rows:
        return None
    biggest, total = counts.agg(F.max(count), F.sum(count)).first()
    if biggest is None:
        return None
    limit = max(cfg.hot_rows, total // cfg.max_hot_groups)
    if biggest <= limit:
        return None
    return counts.where(F.col(count) > limit).select(*[quoted(k) for k in keys], count)


def split_by(df: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of other groups, rows of hot groups). ``hot`` has a size bound, see above."""
    hot_keys = F.broadcast(hot.select(*[quoted(k) for k in keys]))
    return df.join(hot_keys, keys, "left_anti"), df.join(hot_keys, keys, "left_semi")


def ordered_chunks(df: DataFrame, order: list[Column], rows: int, cfg: LedgerConfig) -> DataFrame:
    """Add a chunk number that never falls along ``order``.

    Spark's range partitioning cuts on the whole order, so a group that fills the
    leading columns is cut within. The result is checkpointed: the numbers come
    from sampled bounds and must stay the same for everyone who reads them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    chunk_rows = max(cfg.hot_rows, rows // cfg.max_chunks)
    chunks = max(1, math.ceil(rows / chunk_rows))
    return df.repartitionByRange(chunks, *order).withColumn(CHUNK, F.spark_partition_id()).checkpoint()
