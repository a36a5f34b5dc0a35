"""Files that are written over in place, as a stream.

Spark's file stream sees new names only. This source compares listings: its offset is the map from path to (length, modification time), so
a batch is the difference of two maps. A replay from the checkpoint differs the same maps and gives the same batch, whatever
the folder holds by then. Only names, lengths and times are read; offsets grow with the files watched, which are the sources' own
files, not their rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FORMAT = "edited_files"
CREATED, MODIFIED, DELETED = "created", "modified", "deleted"
SCHEMA = "path string, kind string, length bigint, modified timestamp"


def listing(folders: list[str], recursive: bool = False) -> dict[str, list[int]]:
    """path -> [length, modification time in microseconds] of all files; hidden ones and those of the writer's own are left out."""
    from pyarrow import fs

    found: dict[str, list[int]] = {}
    for folder in folders:
        system, path = fs.FileSystem.from_uri(folder)
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive)):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                found[info.path] = [info.size, (info.mtime_ns or 0) // 1000]
    return found


def differences(before: dict[str, list[int]], after: dict[str, list[int]]) -> Iterator[tuple]:
    """(path, kind, length, modified) of every file that differs, by path."""
    for path in sorted(before.keys() | after.keys()):
        old, new = before.get(path), after.get(path)
        if old == new:
            continue
        length, at = new or old
        kind = CREATED if old is None else DELETED if new is None else MODIFIED
        yield path, kind, length if new else None, dt.datetime.fromtimestamp(at / 1e6, dt.timezone.utc)


class EditReader(SimpleDataSourceStreamReader):
    def __init__(self, folders: list[str], recursive: bool) -> None:
        self.folders, self.recursive = folders, recursive

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = dict(sorted(listing(self.folders, self.recursive).items()))
        return iter(list(differences(start, now))), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(list(differences(start, end)))

    def commit(self, end: dict) -> None:
        pass


class EditedFiles(DataSource):
    """Options: ``path``, folders as URIs, one to a line; ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> EditReader:  # noqa: N802
        folders = [f for f in self.options["path"].split("\n") if f]
        return EditReader(folders, str(self.options.get("recursive", "false")).lower() == "true")


def _uri(path: str) -> str:
    return path if "://" in path else path.replace("file:/", "file:///", 1)


def listed_path(path: str) -> str:
    """A qualified path as listings name it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))[1]


def watch_edits(spark: SparkSession, folders: list[str], recursive: bool = False) -> DataFrame:
    """Stream of (path, kind, length, modified): files created, written over or deleted in the folders."""
    from runledger.sources.files import qualified

    spark.dataSource.register(EditedFiles)
    uris = [_uri(qualified(spark, f)) for f in folders]
    return spark.readStream.format(FORMAT).option("recursive", str(recursive)).option("path", "\n".join(uris)).load()
