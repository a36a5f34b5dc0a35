"""Exact deduplication by deterministic block naming, with DataFrame functions alone.

A text is cut into blocks of a fixed number of bytes. Sorting the blocks brings equal ones
together, and each distinct block gets an integer name: the number of its first row. Then
adjacent names are paired and the pairs are named in the same way, until one name is left
for each text. Names are compared by content at every level, so no two different texts can
share one. The number of rounds is the logarithm of the longest text's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import ascii_lower, hot_hashes
from runledger.session import materialised

BLOCK_BYTES = 16384
#: A key held by more rows than this, and by more than 1/MAX_HOT of all, is named by pre-aggregation.
HOT_ROWS = 2000
MAX_HOT = 256


def named(rows: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """Add ``name``: the smallest ``_bid`` among the rows with these ``keys``; ``_bid`` and ``keys`` go.

    Rows are sorted by key in one shuffle. Keys whose hash (column ``_hash``) is in ``hot`` are
    reduced before their shuffle instead; they are few (see ``hot_hashes``), at most
    MAX_HOT * BLOCK_BYTES bytes, so their names are broadcast.
    """
    rest = [c for c in rows.columns if c not in {*keys, "_bid", "_hash"}]
    is_hot = F.col("_hash").isin(hot) if hot else F.lit(False)
    cold = rows.where(~is_hot) if hot else rows
    out = cold.withColumn("name", F.min("_bid").over(Window.partitionBy(*keys))).select(*rest, "name")
    if hot:
        few = rows.where(is_hot)
        names = few.groupBy(*keys).agg(F.min("_bid").alias("name"))
        out = out.unionByName(few.join(F.broadcast(names), keys).select(*rest, "name"))
    return out


def _caseless_hash() -> Column:
    """A hash of ``_block`` that is equal for blocks which are equal ignoring the case of A-Z."""
    return F.xxhash64(F.lower(F.decode("_block", "ISO-8859-1")))


def _pairs(level: DataFrame) -> DataFrame:
    """Adjacent names of each text as one row ``_a, _b``; the last of an odd number is paired with -1."""
    odd = F.col("pos") % 2 == 1
    return level.groupBy("_uid", "n_blocks", "_left", F.expr("pos div 2").cast("int").alias("pos")).agg(
        F.max("doc_id").alias("doc_id"), F.max("_sha").alias("_sha"), F.max(F.when(~odd, F.col("name"))).alias("_a"),
        F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("_b")).withColumn("_hash", F.xxhash64("_a", "_b"))


def text_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``_uid, doc_id, text_sha256, n_blocks, name``.

    Rows have equal texts, after lower-casing A-Z, exactly when (n_blocks, name) are equal.
    A null text counts as empty; an empty text is one empty block. Other columns are ignored. ``docs`` is scanned more
    than once and must give its rows in the same order each time, as stored tables do.
    """
    whole = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("_uid"), ascii_lower(F.coalesce("text", F.lit(""))).alias("_t"))
    cut = whole.select(
        "doc_id", "_uid", F.sha2("_t", 256).alias("_sha"), F.col("_t").cast("binary").alias("_b"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("_t") / block_bytes)).cast("int").alias("n_blocks"))
    parts = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.substring(F.col("_b"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = (
        cut.select("doc_id", "_uid", "_sha", "n_blocks", F.posexplode(parts).alias("pos", "_block"))
        .withColumn("_sha", F.when(F.col("pos") == 0, F.col("_sha")))
        .withColumns({"_bid": F.monotonically_increasing_id(), "_hash": _caseless_hash()}))
    # Equal blocks are equal ignoring case too, so this cheaper hash finds every hot block.
    raw = docs.select(F.coalesce("text", F.lit("")).alias("_t"))
    raw = raw.select(F.col("_t").cast("binary").alias("_b"), F.greatest(F.lit(1), F.ceil(F.octet_length("_t") / block_bytes)).cast("int").alias("n_blocks"))
    hashes = raw.select(F.explode(parts).alias("_block")).select(_caseless_hash().alias("_hash"))
    hot = hot_hashes(hashes, "_hash", hot_rows, MAX_HOT)
    level = materialised(named(blocks, ["_block"], hot))

    cols = ["_uid", "doc_id", "_sha", "n_blocks", "name"]
    done = [level.where("n_blocks = 1").select(*cols)]
    level = level.where("n_blocks > 1").withColumn("_left", F.col("n_blocks"))
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    while most > 1:
        pairs = materialised(_pairs(level))
        hot = hot_hashes(pairs, "_hash", hot_rows, MAX_HOT)
        rows = pairs.withColumn("_bid", F.monotonically_increasing_id())
        level = materialised(named(rows, ["_a", "_b"], hot).withColumn("_left", F.expr("(_left + 1) div 2").cast("int")))
        done.append(level.where("_left = 1").select(*cols))
        level = level.where("_left > 1")
        most = (most + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("_sha", "text_sha256")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null is the smallest; of rows that
    repeat a doc_id, one stays). An empty table gives no rows.
    """
    ids = text_identities(docs, block_bytes, hot_rows)
    groups = ids.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "_uid")).alias("_keep"), F.count("*").alias("group_size")).where("group_size > 1")
    # Stored, so that Spark sees its size and can split the rows of a large group in the join.
    groups = materialised(groups)
    joined = ids.join(groups, ["n_blocks", "name"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("_keep").isNull(), F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_keep").isNull() | (F.col("_keep._uid") == F.col("_uid"))).alias("kept"),
        "text_sha256")
