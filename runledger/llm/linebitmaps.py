"""Line deduplication with keep bitmaps, with DataFrame functions alone.

Long lines become 128-bit hashes. The hashes are range-partitioned and, in each partition,
sorted by hash, then by document and position; so the first row of a hash belongs to the
document that keeps its lines, and one pass over the stream settles all others. The result
is a bitmap per document, 64 lines a word, for documents that lose lines; no text is shuffled
to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.frames import ascii_lower, columns_of, hot_hashes, whole_row
from runledger.session import materialised

MIN_CHARS = 40
MIN_DOCS = 5
HOT_ROWS = 2000
MAX_HOT = 256
BLANKS = " \t\n\x0b\x0c\r"
_ROW = ["doc_id", "_row"]


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and ``_row``, which tells apart different texts under one doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("_row", F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, _row, pos, _h1, _h2 of each line whose key has at least ``min_chars`` code points.

    A key is the line without the blanks at its ends, A-Z in lower case.
    """
    lines = _with_row(docs).select(*_ROW, F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "_line"))
    keys = lines.select(*_ROW, "pos", F.btrim("_line", F.lit(BLANKS)).alias("_key")).where(F.char_length("_key") >= min_chars)
    return keys.select(*_ROW, "pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))


def dropped_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, _row, pos of the lines that go: their key is in ``min_docs`` documents, and this is not the last of them."""
    hot = hot_hashes(hashes, "_h1", hot_rows, MAX_HOT)
    cold = hashes.where(~F.col("_h1").isin(hot)) if hot else hashes
    stream = Window.partitionBy("_h1", "_h2").orderBy(F.col("doc_id").desc_nulls_last(), "_row", "pos")
    whole = Window.partitionBy("_h1", "_h2").orderBy(F.col("doc_id").desc_nulls_last(), "_row", "pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    n = hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    marked = (
        cold.repartitionByRange(int(n), "_h1")
        .withColumn("_new", (F.row_number().over(stream) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream)))
        .withColumns({"_owner": F.first("doc_id").over(whole), "_docs": F.sum(F.col("_new").cast("long")).over(whole)}))
    gone = marked.where((F.col("_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("_owner"))).select(*_ROW, "pos")
    if not hot:
        return gone
    # Fewer than MAX_HOT keys: reduced in two steps before anything of theirs is shuffled, then broadcast.
    many = hashes.where(F.col("_h1").isin(hot))
    each = many.groupBy("_h1", "_h2", "doc_id").agg(F.lit(1).alias("_one"))
    owners = each.groupBy("_h1", "_h2").agg(F.max("doc_id").alias("_owner"), F.count("*").alias("_docs")).where(F.col("_docs") >= min_docs)
    many = many.join(F.broadcast(owners), ["_h1", "_h2"]).where(~F.col("doc_id").eqNullSafe(F.col("_owner")))
    return gone.unionByName(many.select(*_ROW, "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, _row, n_dropped, drops: one row for each document that loses lines.

    ``drops`` is the complement of the keep bitmap: array of 64-bit words, bit ``pos % 64`` of word
    ``pos div 64`` set for a line that goes. Words after the last such line, and whole documents
    that lose nothing, are left out, which is what compresses it.
    """
    gone = dropped_lines(materialised(line_hashes(docs, min_chars)), min_docs, hot_rows)
    # Repeated rows (same doc_id and text) give the same positions; bits count them once.
    words = materialised(gone.groupBy(*_ROW, F.expr("pos div 64").cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")).alias("_bits")))
    gaps = words.groupBy(*_ROW).agg(F.max("_word").alias("_last")).where("_last > 0").select(
        *_ROW, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_word"), F.lit(0).cast("long").alias("_bits"))
    dense = words.unionByName(gaps).groupBy(*_ROW, "_word").agg(F.bit_or("_bits").alias("_bits"))
    return dense.groupBy(*_ROW).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"]).alias("drops"),
        F.sum(F.bit_count("_bits")).cast("long").alias("n_dropped"))


def _goes(pos: Column, drops: Column) -> Column:
    """Is the bit of line ``pos`` set?"""
    word = F.coalesce(F.get(drops, (pos / 64).cast("int")), F.lit(0).cast("long"))
    return F.getbit(word, (pos % 64).cast("int")) == 1


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with the kept lines as ``text``, and, with ``counts``, ``n_lines``, ``n_dropped`` (long) beside them.

    A null text stays null where the document loses nothing, which is always; it counts as one empty line.
    """
    left = docs.select(whole_row(docs).alias("_whole"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))
    b = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("_row").alias("_at"), F.col("drops").alias("_drops"), F.col("n_dropped").alias("_gone"))
    joined = left.join(b, left["doc_id"].eqNullSafe(b["_doc"]) & (left["_row"] == b["_at"]), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~_goes(i, F.col("_drops"))), "\n")
    more = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("_gone", F.lit(0)).cast("long")} if counts else {}
    new = {**more, "text": F.when(F.col("_drops").isNull(), F.col("text")).otherwise(kept)}
    out = [new.pop(c).alias(c) if c in new else column for c, column in zip(docs.columns, columns_of("_whole", docs.columns))]
    return joined.select(*out, *[v.alias(c) for c, v in new.items()])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_rows: int = HOT_ROWS, counts: bool = True) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` documents share, but for the last document of each.

    Lines are split at \\n. A document is a doc_id: rows that repeat one count once, and null is one doc_id,
    the smallest. All other columns stay; with ``counts``, ``n_lines`` and ``n_dropped`` are added (and replace columns of these names).
    An empty table gives no rows.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs, hot_rows), counts)
