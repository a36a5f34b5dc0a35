"""Checks on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import quoted


class DuplicateKeyError(ValueError):
    """The merged table holds a key more than once."""


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows. NULL is no key."""
    k = quoted(key)
    return df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str, examples: int = 5) -> None:
    found = duplicate_keys(df, key).limit(examples).collect()
    if found:
        names = ", ".join(f"{r[0]!r} ({r['n']} rows)" for r in found)
        raise DuplicateKeyError(f"{key} is not unique: {names}")
