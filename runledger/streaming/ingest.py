"""Continuous refresh: a stream of change events drives the incremental update."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.ledger import Ledger
from runledger.streaming.changes import METADATA, REPORT, UNKNOWN, registry_frame, route_changes
from runledger.sources.files import qualified
from runledger.streaming.edits import listed_path, watch_edits
from runledger.streaming.landing import source_path
from runledger.streaming.quiet import QUIET_MS, after_quiet

log = logging.getLogger(__name__)


# Fixed by Spark for this format.
_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def watch_sources(spark: SparkSession, landing: str) -> DataFrame:
    """Stream of (path, modified): one event per new marker.

    The listing alone is read; the content of the marker files is pruned.
    """
    return (
        spark.readStream.format("binaryFile").schema(_LISTING).load(f"{landing.rstrip('/')}/markers/*")
        .select(
            # The path of the source is that of its markers without the version.
            F.regexp_replace("path", "/[^/]*$", "").alias("path"),
            F.col("modificationTime").alias("modified"),
        )
    )


def change_handler(ledger: Ledger, landing: str, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """What happens to a micro-batch of events.

    The batch is the unit of coalescing: however often a source changed in it,
    it is copied once and the table refreshed once. A failure fails the query, and
    the batch is replayed from the checkpoint. With the name of the ``stream`` the table
    knows the batches it holds, and takes none twice.
    """
    return registry_handler(ledger, {source_path(ledger.spark, landing, name): (name, role) for name, role in source_roles(ledger).items()}, stream)


def source_roles(ledger: Ledger) -> dict[str, str]:
    return {s.name: REPORT for s in ledger.reports} | {ledger.metadata.name: METADATA}


def registry_handler(ledger: Ledger, registry: dict[str, tuple[str, str]], stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """The same for any registry from path to (source, role)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = route_changes(batch.select("path"), registry_frame(ledger.spark, registry))
        # One row per configured source, and the unknown paths folded into one.
        found = (
            routed.groupBy("source", "role").agg(F.sum("n_events").alias("n"), F.min("path").alias("example")).collect()
        )
        for r in found:
            if r["role"] == UNKNOWN:
                log.warning("batch %d: %d changes of unknown sources, such as %s", batch_id, r["n"], r["example"])
        changed = {r["source"] for r in found if r["role"] != UNKNOWN}
        if not changed:
            return
        if not ledger.sync([s for s in ledger.sources if s.name in changed]):
            raise RuntimeError(f"batch {batch_id}: not all of {sorted(changed)} could be copied")
        ledger.refresh(full=not ledger.table.exists(), step=(stream, batch_id) if stream else None)

    return handle


def start_refresh_stream(
    ledger: Ledger, landing: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start the stream; with ``available_now`` it handles what has landed and ends."""
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{ledger.cfg.polling_seconds} seconds"}
    return (
        watch_sources(ledger.spark, landing)
        .writeStream.foreachBatch(change_handler(ledger, landing, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def ingest(ledger: Ledger, landing: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Check, copy and build everything once, then keep it current."""
    ledger.bootstrap()
    return start_refresh_stream(ledger, landing, checkpoint, available_now)


def watched_paths(ledger: Ledger) -> dict[str, tuple[str, str]]:
    """Where the files of each source that can change in place begin, as listings name them, with its name and role."""
    roles = source_roles(ledger)
    return {listed_path(qualified(ledger.spark, s.location)): (s.name, roles[s.name]) for s in ledger.sources if not s.immutable}


def start_edit_stream(
    ledger: Ledger, checkpoint: str, quiet_ms: int | None = QUIET_MS, available_now: bool = False, poll: str | None = None
) -> StreamingQuery:
    """Refresh whenever files of the sources are written over in place.

    Sources may be folders of files or single files. A source counts once it has been quiet for ``quiet_ms``, so a burst of writes
    costs one refresh; with None, and with ``available_now``, every difference counts at once.
    """
    registry = watched_paths(ledger)
    folders = [s.location if s.format != "sqlite" else s.location.rsplit("/", 1)[0] for s in ledger.sources if not s.immutable]
    events = watch_edits(ledger.spark, sorted(set(folders)), recursive=True)
    # One condition for each configured source; of nested ones the longer path counts.
    source = F.coalesce(*[F.when(F.col("path").startswith(p), F.lit(p)) for p in sorted(registry, key=len, reverse=True)], F.col("path"))
    events = events.select(source.alias("path"), "modified")
    if quiet_ms is not None and not available_now:
        events = after_quiet(ledger.spark, events, quiet_ms)
    trigger = {"availableNow": True} if available_now else {"processingTime": poll or f"{ledger.cfg.polling_seconds} seconds"}
    return (
        events.writeStream.foreachBatch(registry_handler(ledger, registry, checkpoint)).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


__all__ = ["change_handler", "ingest", "start_edit_stream", "start_refresh_stream", "watch_sources"]
