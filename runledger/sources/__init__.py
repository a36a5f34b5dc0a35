"""Sources and sinks: source databases, snapshots, the merged table, audit log and exports."""

from runledger.sources.databases import SourceDatabase, source_mtimes, validate_sources
from runledger.sources.snapshot import sync_sources
from runledger.sources.store import MergedTable

__all__ = ["MergedTable", "SourceDatabase", "source_mtimes", "sync_sources", "validate_sources"]
