"""Which keys differ between two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import quoted


def changed_keys(new: DataFrame, old: DataFrame | None, key: Column, name: str) -> DataFrame:
    """Keys (as column ``name``, not null, each once) of rows that only one of the two versions has.

    Rows count by key and a hash of all columns, so only those two are shuffled, reduced before. Without an
    old version, or when its columns are others, every key counts as changed.
    """
    if old is None or sorted(new.dtypes) != sorted(old.dtypes):
        return new.select(key.alias(name)).where(F.col(name).isNotNull()).distinct()

    def hashed(df: DataFrame, sign: int) -> DataFrame:
        # A null must not look like a column that is not there.
        values = [c for n in sorted(df.columns) for c in (F.col(quoted(n)), F.col(quoted(n)).isNull())]
        return df.select(key.alias(name), F.xxhash64(*values).alias("_row"), F.lit(sign).alias("_sign"))

    rows = hashed(new, 1).unionByName(hashed(old, -1)).where(F.col(name).isNotNull())
    return rows.groupBy(name, "_row").agg(F.sum("_sign").alias("_n")).where("_n != 0").select(name).distinct()
