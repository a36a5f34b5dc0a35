"""Helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"\x20\x09-\x0D"
#: Texts handed to a vectorised step at once, in bytes; a longer text goes alone.
SLICE_BYTES = 1 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII blanks; 0 for null. Counts by replacement, so no list of the words is made."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]*+[^{BLANKS}]++[{BLANKS}]*+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application; they need not share a disk with the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_runledger_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="runledger-")) / "runledger.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._runledger_shipped = True


def map_texts(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to Arrow slices of the rows; memory is bounded by the slice, not by the batch."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)
            # Workers live on beside those of later stages; memory that they have free goes back.
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, keep: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The rows of ``docs`` for whose batches ``keep`` says true; all columns as they are, whatever their names."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(keep(pa.RecordBatch.from_arrays(batch.columns, names)))

    return map_texts(numbered, run, numbered.schema, f"c{names.index('text')}").toDF(*names)


def quoted(name: str) -> str:
    """A column name of any characters as an expression."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def columns_of(row: str, names: list[str]) -> list[Column]:
    """The columns that ``whole_row`` put together."""
    return [F.col(row).getField(c).alias(c) for c in names]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_hashes(rows: DataFrame, hash_col: str, least: int, most: int) -> list[int]:
    """Hash values that more than ``least`` rows and more than 1/``most`` of all rows share.

    There are fewer than ``most`` of them whatever the data, so the list may go to the driver.
    """
    counts = rows.groupBy(hash_col).count().where(F.col("count") > least)
    total = rows.count()
    return [r[0] for r in counts.where(F.col("count") > total // most).select(hash_col).collect()]
