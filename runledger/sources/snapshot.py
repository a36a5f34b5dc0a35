"""Working copies of sources, so that a refresh reads a state that does not move."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

from runledger.sources import files
from runledger.sources.databases import SourceDatabase, fingerprint

log = logging.getLogger(__name__)


def _copy(spark: SparkSession, source: SourceDatabase, target: str) -> None:
    """Write all tables to new folders, then show them together by one manifest. A source that has not changed is not copied."""
    manifests = files.Manifests(spark, target)
    latest = manifests.latest()
    # Taken before the copy: what changes meanwhile differs at the next sync.
    state = fingerprint(spark, source)
    if latest and state is not None and latest[1].get("fingerprint") == state:
        return
    tables = {}
    for table in source.tables(spark):
        part = files.new_part()
        source.read(spark, table).write.parquet(f"{target}/{part}")
        tables[table] = part
    files.require(spark, target, list(tables.values()))
    manifests.publish(latest[0] if latest else 0, {"source": source.name, "tables": tables, "fingerprint": state})


def sync_sources(
    spark: SparkSession,
    sources: SourceDatabase | list[SourceDatabase] | None,
    targets: str | list[str] | None,
) -> bool:
    """Copy sources to target folders, pair by pair; True when all went well.

    Nothing given or lists of different length copy nothing. A source that is
    missing or fails does not stop the others. An earlier copy stays readable
    until the new one is complete.
    """
    if not sources or not targets:
        log.error("sync needs sources and targets")
        return False
    sources = sources if isinstance(sources, list) else [sources]
    targets = targets if isinstance(targets, list) else [targets]
    if len(sources) != len(targets):
        log.error("sync got %d sources but %d targets", len(sources), len(targets))
        return False
    done = True
    for source, target in zip(sources, targets):
        if not source.exists(spark):
            log.warning("source %s not found at %s", source.name, source.location)
            done = False
            continue
        try:
            _copy(spark, source, target.rstrip("/"))
        except Exception:
            log.exception("copy of %s failed", source.name)
            done = False
    return done


def vacuum_snapshot(spark: SparkSession, target: str, keep: int = 2, grace: float = files.GRACE_SECONDS) -> int:
    """Delete folders that none of the newest ``keep`` manifests names and that are older than ``grace`` seconds."""
    manifests = files.Manifests(spark, target)
    used = {p for n in manifests.numbers()[-keep:] for p in manifests.read(n)["tables"].values()}
    return files.remove_stale(spark, target.rstrip("/"), used, grace)
