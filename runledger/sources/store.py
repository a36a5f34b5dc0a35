"""The merged table on disk.

A base written by a full build, and small parts with the rows upserted since. A
refresh of a few hundred samples writes a few hundred rows, whatever the size of
the base. Readers leave out base rows that a part replaces.

Every base part has an index of the keys of its files. Once enough rows are pending, the files that may hold
their keys are written anew together with them, as a further base part, and the manifest names the files that are gone. The
others are not opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runledger.config import LedgerConfig
from runledger.functions import quoted
from runledger.operators.checks import assert_unique
from runledger.operators.merge import PROJECT_ID, RAW_FILE
from runledger.operators.upsert import bounded
from runledger.sources import files, keyindex

MAX_PARTS = 16
#: Files that a manifest may name as gone, and the share of all base files; beyond, the whole base is written anew.
MAX_GONE = 2000
GONE_SHARE = 0.5
_SEQ = "_seq"


class MergedTable:
    def __init__(self, spark: SparkSession, root: str, cfg: LedgerConfig) -> None:
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg
        self.manifests = files.Manifests(spark, self.root)

    def _read(self, number: int) -> dict:
        """A manifest; one of a table without key indexes names its base alone, and all its files may hold any key."""
        state = self.manifests.read(number)
        if isinstance(state["base"], str):
            state |= {"base": [state["base"]], "gone": [], "index": {}}
        return state

    def _state(self) -> tuple[int, dict]:
        numbers = self.manifests.numbers()
        if not numbers:
            raise FileNotFoundError(f"no merged table at {self.root}; run a full refresh first")
        return numbers[-1], self._read(numbers[-1])

    def exists(self) -> bool:
        return self.manifests.latest() is not None

    @property
    def generation(self) -> str:
        """Name of the last full build."""
        return self._state()[1]["generation"]

    def row_count(self) -> int:
        return self._state()[1]["rows"]

    def schema(self) -> StructType:
        return self._load(self._state()[1]["base"][0]).schema

    def _load(self, *parts: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts])

    def _base(self, state: dict, only: list[str] | None = None) -> DataFrame:
        """The rows of the base files, or of those among them named; Spark opens no others."""
        rows, name = self._load(*state["base"]), F.col("_metadata.file_name")
        columns = [quoted(c) for c in rows.columns]
        if only is not None:
            rows = rows.where(name.isin([f for f in only if f not in set(state["gone"])]))
        elif state["gone"]:
            rows = rows.where(~name.isin(state["gone"]))
        return rows.select(*columns)

    def stage(self, rows: DataFrame) -> str:
        """Write rows to a new folder that no manifest shows yet.

        Within each file rows are sorted by project and time, so that a query for
        one project skips most pages. This needs no further shuffle.
        """
        part = files.new_part()
        rows.sortWithinPartitions(PROJECT_ID, "DateTime").write.parquet(f"{self.root}/{part}")
        return part

    def staged(self, part: str) -> DataFrame:
        return self._load(part)

    def versions(self) -> dict[str, str]:
        """Version of each source that the table holds; sources without versions are missing."""
        return self._state()[1].get("versions", {})

    @staticmethod
    def _named(state: dict) -> list[str]:
        """All parts that a manifest shows."""
        return [*state["base"], *state["parts"], *(i["part"] for i in state["index"].values())]

    def _publish(self, after: int, state: dict) -> None:
        files.require(self.spark, self.root, self._named(state))
        self.manifests.publish(after, state)

    def _stage_base(self, rows: DataFrame, n_files: int | None = None) -> tuple[str, dict]:
        """Stage rows ranged by project and time, so that a question about one project opens few files, and their key index."""
        order = [F.col(PROJECT_ID).asc_nulls_first(), F.col("DateTime").asc_nulls_first()]
        part = self.stage(rows.repartitionByRange(n_files, *order) if n_files else rows.repartitionByRange(*order))
        stored = self._load(part)
        count, n = stored.count(), len(stored.inputFiles())
        buckets = keyindex.buckets_for(count, n)
        index = files.new_part()
        keyindex.file_index(stored, RAW_FILE, buckets).write.parquet(f"{self.root}/{index}")
        return part, {"part": index, "buckets": buckets, "files": n}

    def touched_files(self, keys: DataFrame, state: dict | None = None) -> tuple[list[str] | None, int]:
        """(base files that may hold one of the keys (RAW_FILE), all base files); None in place of more than MAX_GONE names."""
        state = state or self._state()[1]
        if not state["index"]:
            return None, 0
        found: set[str] = set()
        for i in state["index"].values():
            names = keyindex.touched_files(self._load(i["part"]), keys, RAW_FILE, i["buckets"]).limit(MAX_GONE + 1).collect()
            found |= {r[0] for r in names}
        found -= set(state["gone"])
        total = sum(i["files"] for i in state["index"].values()) - len(state["gone"])
        return (None if len(found) > MAX_GONE else sorted(found)), total

    def holding(self, keys: DataFrame) -> DataFrame:
        """RAW_FILE of all rows in the files that may hold one of the keys, and of the pending ones."""
        _, state = self._state()
        only, _ = self.touched_files(keys, state)
        rows = self._base(state, only).select(RAW_FILE)
        return rows.unionByName(self._load(*state["parts"]).select(RAW_FILE)).distinct() if state["parts"] else rows

    def rows_of(self, keys: DataFrame, n: int) -> DataFrame:
        """The table's rows of the given files (RAW_FILE, unique, ``n`` of them), from the files that may hold them."""
        _, state = self._state()
        rows = self._rows(state, state["parts"], state["pending"], self.touched_files(keys, state)[0])
        return rows.join(bounded(keys, n, self.cfg), RAW_FILE, "left_semi").select(*[quoted(c) for c in rows.columns])

    @property
    def number(self) -> int:
        """Number of the manifest that counts; it rises with every change."""
        return self._state()[0]

    def has_done(self, step: tuple[str, int] | None) -> bool:
        """Has this step (stream, number) or a later one of the stream changed the table already?"""
        return step is not None and self.exists() and self._state()[1].get("steps", {}).get(step[0], -1) >= step[1]

    @staticmethod
    def _noted(state: dict, audit: dict | None, step: tuple[str, int] | None) -> dict:
        """The entry of the refresh log, and the last step of every stream."""
        steps = {**state.get("steps", {}), **({step[0]: step[1]} if step else {})}
        return {"audit": audit, "steps": steps}

    def replace(
        self, merged: DataFrame, versions: dict[str, str] | None = None, n_files: int | None = None, audit: dict | None = None,
        step: tuple[str, int] | None = None,
    ) -> int:
        """Full build. A file name that occurs twice fails it and leaves the table as it was."""
        part, index = self._stage_base(merged, n_files)
        rows = self._load(part)
        assert_unique(rows, RAW_FILE)
        number = rows.count()
        latest = self.manifests.latest()
        self._publish(latest[0] if latest else 0, {
            "generation": part, "base": [part], "gone": [], "index": {part: index}, "parts": [], "pending": 0, "rows": number,
            "versions": versions or {}, **self._noted(latest[1] if latest else {}, audit, step)})
        return number

    def _compacted(self, state: dict, parts: list[str], pending: int) -> dict:
        """``base``, ``gone`` and ``index`` with the pending rows among the base: only files that may hold their keys are written anew."""
        touched, total = self.touched_files(self._load(*parts).select(RAW_FILE), state)
        gone = None if touched is None else [*state["gone"], *touched]
        if gone is None or len(gone) > MAX_GONE or len(gone) > GONE_SHARE * (total + len(state["gone"])):
            part, index = self._stage_base(self._rows(state, parts, pending))
            return {"base": [part], "gone": [], "index": {part: index}}
        part, index = self._stage_base(self._rows(state, parts, pending, touched))
        return {"base": [*state["base"], part], "gone": gone, "index": {**state["index"], part: index}}

    def upsert(
        self, part: str, updates: int, inserted: int, versions: dict[str, str] | None = None, audit: dict | None = None,
        step: tuple[str, int] | None = None,
    ) -> int:
        """Show a staged part of ``updates`` rows, ``inserted`` of them new. Returns the row count.

        ``versions`` are those of the sources after this; without them the earlier ones stay. ``audit`` is noted in the refresh
        log, and ``step`` as done, by the same manifest.
        """
        number, state = self._state()
        parts, pending = [*state["parts"], part], state["pending"] + updates
        base, rows = {k: state[k] for k in ("base", "gone", "index")}, state["rows"] + inserted
        # A single part is the newest version of its rows already.
        if len(parts) > 1 and (len(parts) >= MAX_PARTS or pending > self.cfg.compact_rows):
            parts = [self.stage(self._latest(parts))]
            pending = self._load(parts[0]).count()
        if pending > self.cfg.compact_rows:
            base, parts, pending = self._compacted(state, parts, pending), [], 0
        self._publish(number, {
            "generation": state["generation"], **base, "parts": parts, "pending": pending, "rows": rows,
            "versions": state.get("versions", {}) if versions is None else versions, **self._noted(state, audit, step)})
        return rows

    def _latest(self, parts: list[str]) -> DataFrame:
        """The newest version of each upserted file; at most MAX_PARTS parts are open."""
        if len(parts) == 1:
            return self._load(parts[0])
        tagged = [self._load(p).withColumn(_SEQ, F.lit(i)) for i, p in enumerate(parts)]
        rows = reduce(lambda a, b: a.unionByName(b), tagged)
        versions = Window.partitionBy(RAW_FILE).orderBy(F.col(_SEQ).desc())
        return rows.withColumn("_rn", F.row_number().over(versions)).where("_rn = 1").drop("_rn", _SEQ)

    def _rows(self, state: dict, parts: list[str], pending: int, only: list[str] | None = None) -> DataFrame:
        """Base rows, of all files or of those named, after the pending parts."""
        rows = self._base(state, only)
        if not parts:
            return rows
        new = self._latest(parts)
        # `pending` counts the rows of all parts and is kept below compact_rows.
        kept = rows.join(bounded(new.select(RAW_FILE), pending, self.cfg), RAW_FILE, "left_anti")
        cols = [quoted(c) for c in rows.columns]
        return kept.select(*cols).unionByName(new.select(*cols))

    def read(self) -> DataFrame:
        _, state = self._state()
        return self._rows(state, state["parts"], state["pending"])

    def vacuum(self, keep: int = 2, grace: float = files.GRACE_SECONDS) -> int:
        """Delete folders that none of the newest ``keep`` manifests names and that are older than ``grace`` seconds."""
        used = set()
        for n in self.manifests.numbers()[-keep:]:
            used |= set(self._named(self._read(n)))
        return files.remove_stale(self.spark, self.root, used, grace)
