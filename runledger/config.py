"""Settings: metric catalogue, required columns, thresholds and size limits."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Metric:
    """One metric of the catalogue. A key ending in ``_iQC`` reads the control column."""

    key: str
    column: str
    label: str
    graph_id: str = ""

    @property
    def merged_column(self) -> str:
        return self.column + "_iQC" if self.key.endswith("_iQC") else self.column


# The metric catalogue (key, column, label, graph id), in display order.
DEFAULT_METRICS = (
    Metric("Protein", "Protein", "Proteins Identified MQQC", "Protein-graph"),
    Metric("msms_count", "msms.count", "Peptide counts MQQC", "AllPeptides-graph"),
    Metric("Intensity_100", "Intensity.100.", "Max Intensity MQQC", "Int-graph"),
    Metric("Intensity_100_iQC", "Intensity.100.", "Max Intensity iQC", "IntiQC-graph"),
    Metric("Intensity_50", "Intensity.50.", "MS Median Intensity MQQC", "MedInt-graph"),
    Metric("Intensity_50_iQC", "Intensity.50.", "MS Median Intensity iQC", "MedIntiQC-graph"),
    Metric("missed_cleavages_percent", "missed.cleavages.percent", "Missed Cleavages % MQQC", "MisCleave-graph"),
    Metric("InitialPressure_Pump", "InitialPressure_Pump", "Initial Pressure (Pump)", "InitialPressure-graph"),
    Metric("MaxPressure_Pump", "MaxPressure_Pump", "Max Pressure (Pump)", "MaxPressure_Pump-graph"),
    Metric("MinPressure_Pump", "MinPressure_Pump", "Min Pressure (Pump)", "MinPressure-graph"),
    Metric("Std_Pressure_Pump", "Std_Pressure_Pump", "Std Pressure (Pump)", "StdPressure-graph"),
    Metric("AnalyzerTemp_mean", "AnalyzerTemp_mean", "Analyzer Massspec mean temperature (°C)", "AnalyzerTempMean-graph"),
    Metric("AnalyzerTemp_std", "AnalyzerTemp_std", "Analyzer Massspec std temperature (°C)", "AnalyzerTempStd-graph"),
    Metric("precision_50", "precision.50.", "Median Mass Precision [ppm] MQQC", "Precision-graph"),
)

# Required tables, report columns and detail columns.
REPORT_TABLES = ("SingleFileReport",)
METADATA_TABLES = ("Metadata_Project", "Metadata_Sample")
REPORT_KEY_COLUMNS = ("Name", "System.Time.s")
DETAIL_COLUMNS = ("MSInstrument", "HPLCInstrument", "InstrumentMethod_print", "SoftwareVersion")


@dataclass(frozen=True)
class LedgerConfig:
    """All parameters of the engine.

    The first block decides results; the second only decides how work is split
    over tasks and never changes a result.
    """

    metrics: tuple[Metric, ...] = DEFAULT_METRICS
    report_key_columns: tuple[str, ...] = REPORT_KEY_COLUMNS
    detail_columns: tuple[str, ...] = DETAIL_COLUMNS
    report_tables: tuple[str, ...] = REPORT_TABLES
    metadata_tables: tuple[str, ...] = METADATA_TABLES
    standards_mode: str = "literal"
    rolling_width: int = 15
    rolling_threshold: int = 30
    static_floor: int = 5
    layout_threshold: int = 75
    recent_rows: int = 500
    polling_seconds: int = 60

    # A group above `hot_rows` rows is split over tasks. The limit rises with the
    # data so that never more than `max_hot_groups` groups are hot: the list of
    # hot groups therefore has a fixed size bound and may be broadcast.
    hot_rows: int = 1_000_000
    max_hot_groups: int = 100_000
    max_chunks: int = 10_000
    # Key lists up to this many rows may be broadcast.
    broadcast_rows: int = 200_000
    # An upserted table is rewritten once its pending changes reach this many rows.
    compact_rows: int = 200_000

    def __post_init__(self) -> None:
        lower_bounds = {
            "rolling_width": 1, "rolling_threshold": 2, "layout_threshold": 1, "recent_rows": 2,
            "polling_seconds": 1, "hot_rows": 1, "max_hot_groups": 1, "max_chunks": 2,
            "broadcast_rows": 0, "compact_rows": 1, "static_floor": 0,
        }
        for name, low in lower_bounds.items():
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < low:
                raise ValueError(f"{name} must be an integer of at least {low}, got {value!r}")
        if self.standards_mode not in ("literal", "pattern"):
            raise ValueError(f"standards_mode must be 'literal' or 'pattern', got {self.standards_mode!r}")
        keys = [m.key for m in self.metrics]
        if len(set(keys)) != len(keys):
            raise ValueError(f"metric keys repeat: {keys}")
        if len(self.report_key_columns) < 2:
            raise ValueError("report_key_columns needs the name and the time column first")

    @property
    def name_column(self) -> str:
        return self.report_key_columns[0]

    @property
    def time_column(self) -> str:
        return self.report_key_columns[1]

    @property
    def report_columns(self) -> list[str]:
        """Columns wanted from a report, each once, in catalogue order."""
        return list(dict.fromkeys([*self.report_key_columns, *(m.column for m in self.metrics)]))

    def metric(self, key: str) -> Metric:
        for m in self.metrics:
            if m.key == key:
                return m
        raise KeyError(f"unknown metric {key!r}; known: {[m.key for m in self.metrics]}")

    def with_(self, **changes: Any) -> "LedgerConfig":
        return replace(self, **changes)


def default_config(**changes: Any) -> LedgerConfig:
    return LedgerConfig(**changes)


__all__ = ["DEFAULT_METRICS", "LedgerConfig", "Metric", "default_config"]
