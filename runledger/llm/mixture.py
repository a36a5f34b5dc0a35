"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. Of a source, the documents below a threshold make up its share of the mix, so all that is
needed is the threshold at which their words reach the budget. Words are summed by source and leading bits of the hash;
running sums show the bucket in which a budget is reached; only documents of these buckets are summed again by the next
bits, until the bucket is one hash. The mix is then a filter: no sort, and no state that grows with a source. A larger
budget has a larger threshold, so a smaller mix is a part of every larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import word_count
from runledger.session import materialised

#: Words of the mix over words of all documents, times that a document may occur, and weights of the sources in order, repeating.
SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
#: Bits of a document's hash, and bits that one round of sums resolves.
HASH_BITS = 60
LEVEL_BITS = 12


def _hash_of(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key`` (its source, never null), ``_size`` in words and ``_h``, the hash of doc_id and text."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return docs.withColumns({
        "_key": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")),
        "_size": word_count(F.col("text")), "_h": _hash_of(F.md5(name.cast("binary")))})


def weighted_sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_key, source_size, _weight, stored. Sources are numbered by code point, null last; a task sees one range of them."""
    sizes = rows.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    order = [F.col("_key") == "", F.col("_key")]
    ranged = materialised(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    firsts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_first")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return materialised(ranged.join(firsts, "_part").select("_key", "source_size", weight.alias("_weight")))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` with ``target``: words by weight, ``share`` of all words together, none above ``most`` times its source.

    What a full source cannot take goes to the others by weight; a round is one small aggregation, and every round but the
    last fills a source. Where ``share`` is ``most`` or more, every source is full.
    """
    cap = F.col("source_size") * most
    level, full = 0.0, -1
    while True:
        is_full = F.col("_weight") * F.lit(level) > cap
        n, taken, open_weight, words = sources.agg(
            F.count_if(is_full), F.sum(F.when(is_full, cap).otherwise(0)), F.sum(F.when(~is_full, F.col("_weight")).otherwise(0)), F.sum("source_size")).first()
        if n == full or not words:
            break
        if not open_weight:
            return sources.withColumn("target", cap.cast("double"))
        full, level = n, (share * words - taken) / open_weight
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("_weight") * F.lit(level)))


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = LEVEL_BITS) -> DataFrame:
    """Where each budget is reached: ``budgets`` with ``_cut``, ``_below``, ``_n`` and ``_sum``, stored.

    ``rows`` has ``_key``, ``_h``, ``_size``; ``budgets`` has ``_key``, ``_mix``, ``_budget``, any number of budgets for a key.
    Rows of smaller hash than ``_cut`` have ``_below`` words together, at most the budget; the ``_n`` rows of that hash have ``_sum``,
    which goes beyond it. A budget that all rows together do not exceed gets a cut above every hash, and 0 for the others.
    """
    out = None
    at = budgets.withColumns({"_prefix": F.lit(0).cast("long"), "_below": F.lit(0).cast("long")})
    inside, shift = rows, HASH_BITS
    while True:
        last, shift = shift, max(0, shift - bits)
        sums = inside.groupBy("_key", F.shiftright("_h", shift).alias("_bucket")).agg(
            F.sum("_size").alias("_sum"), F.count("*").alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        sums = sums.withColumn("_prefix", F.shiftright("_bucket", last - shift))
        # At most 2 ** bits buckets for each budget.
        up_to = Window.partitionBy("_key", "_mix").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        reached = sums.join(at, ["_key", "_prefix"]).withColumn("_to", F.col("_below") + F.sum("_sum").over(up_to))
        reached = reached.where((F.col("_to") > F.col("_budget")) & (F.col("_to") - F.col("_sum") <= F.col("_budget")))
        at = materialised(reached.select(
            "_key", "_mix", "_budget", F.col("_bucket").alias("_prefix"), (F.col("_to") - F.col("_sum")).alias("_below"), "_n", "_sum", "_lo", "_hi"))
        one = F.col("_lo") == F.col("_hi")
        found = at.where(one).select("_key", "_mix", F.col("_lo").alias("_cut"), "_below", "_n", "_sum")
        out = found if out is None else out.unionByName(found)
        at = at.where(~one).drop("_n", "_sum", "_lo", "_hi")
        if not shift or at.isEmpty():
            break
        inside = rows.withColumn("_prefix", F.shiftright("_h", shift)).join(at.select("_key", "_prefix").distinct(), ["_key", "_prefix"], "left_semi").drop("_prefix")
    whole = budgets.join(out, ["_key", "_mix"], "left")
    return materialised(whole.withColumns({
        "_cut": F.coalesce("_cut", F.lit(1 << HASH_BITS)), "_below": F.coalesce("_below", F.lit(0)), "_n": F.coalesce("_n", F.lit(0)), "_sum": F.coalesce("_sum", F.lit(0))}))


def marks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``_key``, ``source_size``, ``target``) with ``_full``, ``_cut``, ``_k``, ``_n``.

    Every row is taken ``_full`` times, rows below ``_cut`` once more, and of the ``_n`` rows at the cut ``_k``: as many as come
    nearest to the target, the fewer of two equally near numbers. Rows of one hash have the same doc_id and text.
    """
    full = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    wanted = wanted.withColumn("_full", full).withColumn("_mix", F.lit(0)).withColumn("_budget", F.col("target") - F.col("_full") * F.col("source_size"))
    cuts = thresholds(rows, wanted.select("_key", "_mix", "_budget"))
    each = F.try_divide("_sum", "_n")
    more = F.ceil(F.coalesce(F.try_divide(F.col("_budget") - F.col("_below"), each), F.lit(0.0)) - 0.5)
    cuts = cuts.withColumn("_k", F.greatest(F.lit(0), F.least(F.col("_n"), more)).cast("long"))
    return materialised(wanted.select("_key", "source_size", "target", "_full").join(cuts.select("_key", "_cut", "_k", "_n"), "_key"))


def decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with ``_key``, ``_h``, ``_size``) and ``source_size``, ``target``, ``_copies``: how often the mix takes each.

    Where some but not all rows of the hash at the cut are taken, these are stored and numbered by a second, unique hash, in the
    same way; all others are filtered as they are read.
    """
    tied = (F.col("_h") == F.col("_cut")) & (F.col("_k") > 0) & (F.col("_k") < F.col("_n"))
    below = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col("_k") >= F.col("_n")) & (F.col("_n") > 0))
    names = [*rows.columns, "source_size", "target"]
    both = rows.join(cuts, "_key")
    copies = lambda more: (F.col("_full") + F.when(more, 1).otherwise(0)).cast("long").alias("_copies")
    out = both.select(*[f"`{c}`" for c in names], copies(below), tied.alias("_tied"))
    partial = materialised(cuts.where("_k > 0 AND _k < _n"))
    if partial.isEmpty():
        return out.drop("_tied")
    ties = materialised(rows.join(partial, "_key").where(tied).withColumn("_uid", F.monotonically_increasing_id()))
    ties = ties.withColumn("_h", _hash_of(F.md5(F.col("_uid").cast("string").cast("binary")))).withColumnRenamed("_size", "_words").withColumn("_size", F.lit(1).cast("long"))
    nth = thresholds(ties, partial.select("_key", F.lit(0).alias("_mix"), F.col("_k").cast("double").alias("_budget")))
    chosen = ties.drop("_cut").join(nth.select("_key", "_cut"), "_key").drop("_size").withColumnRenamed("_words", "_size")
    return out.where("NOT _tied").drop("_tied").unionByName(chosen.select(*[f"`{c}`" for c in names], copies(F.col("_h") < F.col("_cut"))))


def decisions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``; texts are read once.

    A null text has no words, a null source is the last one. Of a source, whole documents are taken in the order of their hashes
    up to the document that brings the sum nearest to the target, so the sum misses it by half that document at most.
    The hash is of doc_id and text; of rows that repeat both, as many are taken as come nearest. An empty table gives no
    rows; other columns are ignored.
    """
    rows = materialised(sized(docs.select("doc_id", "text", "source")).select("doc_id", "_key", "_size", "_h"))
    cuts = marks(rows, targets(weighted_sources(rows, weights), share, most))
    return decided(rows, cuts).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken. See ``decisions``.

    Columns may have any name. Of rows that repeat doc_id and text but not the rest, any may be the ones taken.
    """
    inner = docs.select("doc_id", "text", "source", F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row"))
    rows = sized(inner).select("_row", "_key", "_size", "_h")
    slim = materialised(rows.drop("_row"))
    out = decided(rows, marks(slim, targets(weighted_sources(slim, weights), share, most)))
    repeated = out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select("_row.*")
