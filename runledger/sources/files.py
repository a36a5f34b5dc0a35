"""Small helpers over the Hadoop file system, and numbered manifests.

Spark cannot overwrite a table it is reading. Data is therefore written to new
folders, and a manifest, a small JSON file with the next number, makes it
visible. Readers take the manifest with the highest number.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConcurrentWriteError(RuntimeError):
    """Someone else published the same manifest number first."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible entries of a folder; [] when it is not there."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def _claimed(spark: SparkSession, fs, temp, final) -> bool:
    """Give the finished file its final name unless someone has it; of several writers one succeeds.

    A rename on HDFS does not replace a file. One on a local disk does, so there a hard link is made, which does not.
    """
    if fs.resolvePath(temp).toUri().getScheme() != "file":
        return not fs.exists(final) and fs.rename(temp, final)
    place = lambda p: spark._jvm.java.io.File(fs.resolvePath(p.getParent()).toUri().getPath(), p.getName()).toPath()
    try:
        spark._jvm.java.nio.file.Files.createLink(place(final), place(temp))
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    fs.delete(temp, False)
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears with its whole content or not at all, and never in the place of another."""
    fs, final = _hadoop(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if not _claimed(spark, fs, temp, final):
        fs.delete(temp, False)
        raise ConcurrentWriteError(f"{path} exists already")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def age_seconds(spark: SparkSession, path: str) -> float:
    """Time since the entry last changed."""
    fs, p = _hadoop(spark, path)
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000


def remove_stale(spark: SparkSession, root: str, used: set[str], grace: float) -> int:
    """Delete the folders below ``root``/parts that are not used and older than ``grace`` seconds.

    A part is written before a manifest shows it, so a young one may belong to a refresh that still runs.
    """
    stale = [f"{root}/parts/{p}" for p in children(spark, f"{root}/parts") if f"parts/{p}" not in used]
    stale = [p for p in stale if age_seconds(spark, p) >= grace]
    for p in stale:
        remove_tree(spark, p)
    return len(stale)


def require(spark: SparkSession, root: str, parts: list[str]) -> None:
    """Fail when a part that a manifest is about to show is gone."""
    lost = [p for p in parts if not exists(spark, f"{root}/{p}")]
    if lost:
        raise FileNotFoundError(f"{root}: parts {lost} were removed before they could be shown")


def remove_tree(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


#: Unnamed parts younger than this stay, as a running refresh may be about to show them.
GRACE_SECONDS = 24 * 3600.0


class Manifests:
    """Numbered JSON files in one folder; the highest number counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.folder = f"{root.rstrip('/')}/manifests"

    def numbers(self) -> list[int]:
        names = children(self.spark, self.folder)
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/{number:08d}.json"))

    def latest(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def publish(self, after: int, content: dict) -> int:
        """Publish as the successor of manifest ``after`` (0 for the first)."""
        number = after + 1
        write_text(self.spark, f"{self.folder}/{number:08d}.json", json.dumps(content, indent=1, sort_keys=True))
        return number


def new_part() -> str:
    """A folder name nobody has used, relative to the table's root."""
    return f"parts/{uuid.uuid4().hex}"
