"""Values of given ranks by radix selection: rounds of counting, without a sort and without a list of the values.

Each round deals the values that are left of a group into some thousand ordered classes and counts them, with partial sums before
the shuffle; the running count tells the class that holds the rank, and only its values are looked at again. The
first digit divides the range of the group evenly, which settles plain data; the second is a class of magnitude, in which the largest
value is less than 1.43 times the smallest; every further one divides what is left by 4,095. So seven rounds settle any doubles,
whatever their distribution, and a group of any size is counted by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import quoted
from runledger.session import materialised

#: Classes of an even division, and steps of the logarithm of a class of magnitude (doubles go from e^-745 to e^710).
CLASSES = 4095
MAGNITUDES = 2.8
#: So many values of a group may be ranked by a window.
FEW = 4096


def _share(value: Column, lo: Column, hi: Column) -> Column:
    return F.floor(F.coalesce(F.try_divide(value - lo, hi - lo), F.lit(0.0)) * CLASSES)


def digit(value: Column, lo: Column, hi: Column, turn: int) -> Column:
    """The class of a value between ``lo`` and ``hi``; it never falls as the value rises."""
    if turn == 0:
        # Halves, as the whole range may be beyond the largest double; with infinite ends all are one class.
        wide = F.greatest(F.abs(lo), F.abs(hi)) == float("inf")
        return F.when(wide, F.lit(0).cast("bigint")).otherwise(_share(value / 2, lo / 2, hi / 2))
    if turn == 1:
        size = F.floor(F.least((F.ln(F.abs(value)) + 746) * MAGNITUDES, F.lit(4200.0))) + 1
        return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, size).otherwise(-size)
    return _share(value, lo, hi)


def values_of_ranks(values: DataFrame, wanted: DataFrame, keys: list[str], value: str, few: int = FEW) -> DataFrame:
    """``keys``, ``_rank``, ``value`` for each ``keys``, ``_rank`` (from 1, not beyond the group's size) of ``wanted``.

    ``values`` holds no NULL or NaN and is read once a round; ``wanted`` has a proven size bound, as it is broadcast.
    """
    k = [quoted(c) for c in keys]
    v, lo, hi = F.col(quoted(value)), F.col("_lo"), F.col("_hi")
    ends = values.join(F.broadcast(wanted.select(*k).distinct()), keys, "left_semi").groupBy(*k).agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"))
    state = materialised(wanted.select(*k, "_rank", F.col("_rank").alias("_left")).join(F.broadcast(ends), keys))

    def inside(state: DataFrame) -> DataFrame:
        return values.join(F.broadcast(state), keys).where((v >= lo) & (v <= hi))

    turn = 0
    while True:
        many = state.where((lo < hi) & (F.col("_n") > few))
        if many.isEmpty():
            break
        counts = inside(many).groupBy(*k, "_rank", "_left", digit(v, lo, hi, turn).alias("_digit")).agg(
            F.count("*").alias("_here"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        upto = F.sum("_here").over(Window.partitionBy(*k, "_rank").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_here") < F.col("_left")))
        found = found.select(*k, "_rank", (F.col("_left") - F.col("_upto") + F.col("_here")).alias("_left"), lo, hi, F.col("_here").alias("_n"))
        state = materialised(state.where((lo >= hi) | (F.col("_n") <= few)).select(*found.columns).unionByName(found))
        turn += 1
    # What is left of a group is one value, or few enough for one task.
    order = Window.partitionBy(*k, "_rank").orderBy(v)
    few_left = inside(state.where(lo < hi)).withColumn("_at", F.row_number().over(order)).where(F.col("_at") == F.col("_left"))
    return state.where(lo == hi).select(*k, "_rank", lo.alias(value)).unionByName(few_left.select(*k, "_rank", v.alias(value)))


def medians(values: DataFrame, sizes: DataFrame, keys: list[str], value: str, few: int = FEW) -> DataFrame:
    """``keys``, ``median`` of the groups of ``sizes`` (``keys``, ``n``: their values; bounded), as the mean of the two middle values."""
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    wanted = materialised(sizes.where("n > 0").select(*[quoted(c) for c in keys], F.explode(ranks).alias("_rank")))
    found = values_of_ranks(values, wanted, keys, value, few)
    return found.groupBy(*[quoted(c) for c in keys]).agg((F.min(value) * 0.5 + F.max(value) * 0.5).alias("median"))
