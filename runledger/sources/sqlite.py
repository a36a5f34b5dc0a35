"""A Spark data source that reads SQLite files.

Spark has no reader for them without a JDBC driver. The file must lie on a path
that all executors see. A table is cut into ranges of its row ids, which its own
tree is ordered by, so each task reads only its range; rows travel as Arrow batches.
"""

from __future__ import annotations

import sqlite3
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "sqlite_file"
BATCH_ROWS = 20_000


def connect(path: str) -> sqlite3.Connection:
    """Open read-only: a source is never changed."""
    local = path.removeprefix("file://").removeprefix("file:")
    return sqlite3.connect(f"{Path(local).absolute().as_uri()}?mode=ro", uri=True)


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def list_tables(path: str) -> list[str]:
    with closing(connect(path)) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def spark_type(declared: str) -> T.DataType:
    """Column type by SQLite's affinity rules; a column without one is text."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(word in d for word in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if any(word in d for word in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.StringType()


def to_python(value, dtype: T.DataType):
    """The stored value. SQLite keeps any type in any column; one that its column's type cannot hold unchanged is an error."""
    if value is None or (isinstance(dtype, T.StringType) and isinstance(value, str)):
        return value
    if isinstance(dtype, T.StringType):
        return value.decode("utf-8") if isinstance(value, bytes) else str(value)
    if isinstance(dtype, T.LongType) and isinstance(value, int):
        return value
    if isinstance(dtype, T.DoubleType) and isinstance(value, (int, float)) and float(value) == value:
        return float(value)
    raise ValueError(f"{value!r} is stored in a column of type {dtype.simpleString()}; declare the column TEXT to read it")


@dataclass
class RowRange(InputPartition):
    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, schema: T.StructType) -> None:
        self.path, self.table, self.rows, self.schema = path, table, rows, schema

    def partitions(self) -> list[RowRange]:
        with closing(connect(self.path)) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {identifier(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [RowRange(None, None)]  # a table without row ids
        if low is None:
            return [RowRange(0, -1)]  # an empty table still needs one, empty, range
        return [RowRange(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange):
        cols = ", ".join(identifier(f.name) for f in self.schema.fields)
        sql, args = f"SELECT {cols} FROM {identifier(self.table)}", ()
        if partition.low is not None:
            sql, args = sql + " WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)
        target = to_arrow_schema(self.schema)
        with closing(connect(self.path)) as con:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            cursor = con.execute(sql, args)
            while rows := cursor.fetchmany(BATCH_ROWS):
                arrays = [
                    pa.array([to_python(v, f.dataType) for v in column], type=target.field(i).type)
                    for i, (f, column) in enumerate(zip(self.schema.fields, zip(*rows)))
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)


class SqliteDataSource(DataSource):
    """Options: ``path``, ``table``, ``columns`` (comma list, default all), ``rowsPerTask``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        with closing(connect(self.options["path"])) as con:
            info = con.execute(f"PRAGMA table_info({identifier(self.options['table'])})").fetchall()
        if not info:
            raise ValueError(f"no table {self.options['table']!r} in {self.options['path']}")
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        fields = [T.StructField(r[1], spark_type(r[2] or "")) for r in info if not wanted or r[1] in wanted]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> SqliteReader:
        rows = int(self.options.get("rowsPerTask", "500000"))
        return SqliteReader(self.options["path"], self.options["table"], rows, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, **options: str):
    spark.dataSource.register(SqliteDataSource)
    return spark.read.format(FORMAT).options(path=path, table=table, **options).load()
