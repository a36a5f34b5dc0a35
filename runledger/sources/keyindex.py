"""Which files may hold a key: range and Bloom bits of every file of a stored part.

An upsert of few keys asks this small table first and opens only the files that it names. A file has one row for each bucket of the
key's hash, with the smallest and largest key of the bucket and a bitmap of 32,768 bits, in which every key sets two. The
number of buckets follows the rows of a file, so that about 8 bits stand for a key and some 5 % of strange keys within its range find a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: bits of one bitmap of Spark's bitmap functions.
BITS = 32768
BITS_PER_KEY = 8


def buckets_for(rows: int, files: int) -> int:
    """A power of two: buckets of a file with its share of the rows."""
    need = -(-rows * BITS_PER_KEY // (max(1, files) * BITS))
    return 1 << max(0, need - 1).bit_length()


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _place(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BITS))


def file_index(part: DataFrame, key: str, buckets: int) -> DataFrame:
    """file, bucket, lo, hi, bits of a part as read from its files. A NULL key is in no file."""
    k = F.col(key)
    rows = part.select(F.col("_metadata.file_name").alias("file"), k).where(k.isNotNull())
    first, second = _place(k, 1), _place(k, 2)
    each = rows.groupBy("file", _bucket(k, buckets).alias("bucket")).agg(
        F.min(k).alias("lo"), F.max(k).alias("hi"), F.array(F.bitmap_construct_agg(first), F.bitmap_construct_agg(second)).alias("_two"))
    # The two bitmaps of a bucket are made one after the keys have been reduced, so that a key is sorted once.
    both = each.select("file", "bucket", "lo", "hi", F.explode("_two").alias("_bits"))
    return both.groupBy("file", "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bitmap_or_agg("_bits").alias("bits"))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def touched_files(index: DataFrame, keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """file: those that may hold one of the keys; files that hold one are always among them.

    The join is a semi join of the index, so a bucket of a file is settled by the first key that it may hold, and no pairs are made.
    """
    k = F.col(key)
    asked = keys.where(k.isNotNull()).select(
        k.alias("_key"), _bucket(k, buckets).alias("_bucket"), _place(k, 1).alias("_first"), _place(k, 2).alias("_second"))
    near = (F.col("bucket") == F.col("_bucket")) & (F.col("_key") >= F.col("lo")) & (F.col("_key") <= F.col("hi"))
    held = _is_set(F.col("bits"), F.col("_first")) & _is_set(F.col("bits"), F.col("_second"))
    return index.join(asked, near & held, "left_semi").select("file").distinct()
