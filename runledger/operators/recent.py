"""The newest samples of each source, which bound the work of an incremental update."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.config import LedgerConfig
from runledger.functions import epoch_to_timestamp, parse_timestamp, quoted, strip_suffix
from runledger.operators.merge import CREATED, SAMPLE_ID

RECENT_ID = "sample_id"
RECENT_TIME = "Time"


def _newest(df: DataFrame, n: int) -> DataFrame:
    # Sort and limit run as one top-n operator: n rows per task, then n in all.
    return df.orderBy(F.col(RECENT_TIME).desc_nulls_last(), F.col(RECENT_ID).asc_nulls_last()).limit(n)


def distinct_samples(samples: DataFrame) -> DataFrame:
    """(bare file name, creation time), each pair once."""
    return _pairs(samples).distinct()


def _pairs(samples: DataFrame) -> DataFrame:
    return samples.select(
        strip_suffix(F.col(SAMPLE_ID)).alias(RECENT_ID), parse_timestamp(F.col(CREATED)).alias(RECENT_TIME))


def recent_samples_meta(samples: DataFrame, n: int, cfg: LedgerConfig) -> DataFrame:
    """Top n of the distinct samples; each task drops its own copies before the shuffle."""
    return _newest(distinct_samples(samples), n)


def recent_samples_reports(reports: list[DataFrame], n: int, cfg: LedgerConfig) -> list[DataFrame]:
    """Top n of every report source by its own clock."""
    return [
        _newest(
            r.select(
                strip_suffix(F.col(quoted(cfg.name_column))).alias(RECENT_ID),
                epoch_to_timestamp(F.col(quoted(cfg.time_column))).alias(RECENT_TIME),
            ),
            n,
        )
        for r in reports
    ]


def recent_samples(reports: list[DataFrame], samples: DataFrame, n: int, cfg: LedgerConfig) -> DataFrame:
    """Recent samples of the metadata and of every report; a name may repeat.

    At most n rows per source, so its size is known beforehand.
    """
    parts = [recent_samples_meta(samples, n, cfg), *recent_samples_reports(reports, n, cfg)]
    return reduce(lambda a, b: a.unionByName(b), parts)
