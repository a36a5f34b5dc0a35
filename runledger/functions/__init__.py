"""Column expressions. Everything here stays inside the JVM; there is no Python UDF."""

from runledger.functions.names import (
    derive_project,
    file_type,
    is_control,
    quoted,
    strip_last_token,
    strip_suffix,
)
from runledger.functions.text import (
    base_name,
    clean_text,
    contains_ci,
    format_2dp,
    last_measured_text,
    refreshed_text,
    summary_text,
    to_number,
)
from runledger.functions.times import date_time, epoch_to_timestamp, format_minute, format_second, parse_timestamp, time_of_day

__all__ = [
    "base_name", "clean_text", "contains_ci", "date_time", "derive_project", "epoch_to_timestamp",
    "file_type", "format_2dp", "format_minute", "format_second", "is_control", "last_measured_text", "parse_timestamp",
    "quoted", "refreshed_text", "strip_last_token", "strip_suffix", "summary_text", "time_of_day", "to_number",
]
