"""Token counts by an exact histogram of encoded lengths.

Suffix sums over the histogram (documents of at least a length, and their tokens) answer totals, quantiles and
truncated totals for every context limit. Counts are summed in the tasks before the shuffle; the sums run in two
levels, within ranges of lengths and over the ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import map_texts
from runledger.llm.speculativebpe import SLICE, encoder, split_patterns

#: Lengths in one range.
RANGE = 1024


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length, docs: how many rows of ``docs`` have how many tokens. A null text counts as empty, with 0 tokens.

    An empty table gives no rows; other columns are ignored.
    """
    patterns = split_patterns(tokenizer)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, n = np.unique(encoder(tokenizer, patterns).lengths(batch.column(0).to_pylist()), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], ["length", "docs"])

    return map_texts(docs.select("text"), count, "length long, docs long", limit=SLICE).groupBy("length").agg(F.sum("docs").alias("docs"))


def curve(histogram: DataFrame, limits: tuple[int, ...] = (), shares: tuple[float, ...] = ()) -> DataFrame:
    """One row for every length of the histogram and every one of ``limits``, as context limit:

    docs (of exactly this length), docs_at_least, tokens_at_least (of documents of this length or more), docs_truncated (longer
    ones), total_tokens (of all texts cut to the limit) and share_within (of documents that fit; null where there are none). With
    ``shares`` (above 0, up to 1) also quantile_of: those of them that the row's length is the quantile of, see ``quantiles``.
    """
    spark = histogram.sparkSession
    h = histogram
    if limits:
        more = spark.createDataFrame([(int(x), 0) for x in limits], "length long, docs long")
        h = h.unionByName(more).groupBy("length").agg(F.sum("docs").alias("docs"))
    h = h.withColumn("_range", F.expr(f"length div {RANGE}"))
    longer = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("_range")
    # One row for each range: as many as the longest document has ranges.
    ranges = h.groupBy("_range").agg(F.sum("docs").alias("_d"), F.sum(F.col("docs") * F.col("length")).alias("_t")).select(
        "_range", F.coalesce(F.sum("_d").over(longer), F.lit(0)).alias("_docs_after"), F.coalesce(F.sum("_t").over(longer), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(everything).alias("_docs"), F.sum("_t").over(everything).alias("_tokens"))
    down = Window.partitionBy("_range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    inner = h.withColumns({"_a": F.sum("docs").over(down), "_b": F.sum(F.col("docs") * F.col("length")).over(down)})
    at_least, tokens = F.col("_a") + F.col("_docs_after"), F.col("_b") + F.col("_tokens_after")
    shorter, within = (F.try_divide(F.col("_docs") - at_least + n, F.col("_docs")) for n in (F.lit(0), F.col("docs")))
    more = [F.filter(F.array(*map(F.lit, shares)), lambda q: (shorter < q) & (q <= within)).alias("quantile_of")] if shares else []
    return inner.join(ranges, "_range").select(
        F.col("length").alias("context_limit"), "docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (at_least - F.col("docs")).alias("docs_truncated"), (F.col("_tokens") - tokens + F.col("length") * at_least).alias("total_tokens"),
        within.alias("share_within"), *more)


def quantiles(points: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """share, length: the smallest length within which that share of the documents lies, from the rows of ``curve``."""
    found = points.where("docs > 0").agg(*[F.min(F.when(F.col("share_within") >= q, F.col("context_limit"))).alias(f"q{i}") for i, q in enumerate(shares)])
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])
    return found.select(F.explode(pairs).alias("_p")).select("_p.*")
