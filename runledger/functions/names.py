"""Expressions over run and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of raw files, and the texts that mark a standard.
SUFFIXES = (".raw", ".d")
HS_STANDARD = "HSstd"
OTHER_STANDARD = "OtherStandard"
STANDARD_TEXT = "[Ss]tandar[dt]"


def quoted(name: str) -> str:
    """Back-quote a column name, so that a dot in it is not read as a field access."""
    return "`" + name.replace("`", "``") + "`"


def strip_suffix(name: Column) -> Column:
    """Remove one trailing ``.raw`` or ``.d``, in that case only."""
    raw, d = SUFFIXES
    return (
        F.when(F.endswith(name, F.lit(raw)), F.left(name, F.length(name) - len(raw)))
        .when(F.endswith(name, F.lit(d)), F.left(name, F.length(name) - len(d)))
        .otherwise(name)
    )


def is_control(name: Column) -> Column:
    """Control runs carry the raw-file suffix in their name; NULL stays NULL."""
    raw, d = SUFFIXES
    return F.endswith(name, F.lit(raw)) | F.endswith(name, F.lit(d))


def strip_last_token(name: Column) -> Column:
    """Drop the part from the last underscore on; names without one stay."""
    last = F.substring_index(name, "_", -1)
    return F.when(F.contains(name, F.lit("_")), F.left(name, F.length(name) - F.length(last) - 1)).otherwise(name)


def derive_project(name: Column) -> Column:
    """The first three underscore tokens; shorter names give what they have, NULL gives ''."""
    return F.coalesce(F.substring_index(name, "_", 3), F.lit(""))


def file_type(name: Column, standards_mode: str = "literal") -> Column:
    """Class of a run: one of two standards, or its name without the last token.

    ``literal`` looks for the bracketed text itself, as SQL LIKE does;
    ``pattern`` reads the brackets as character classes.
    """
    other = name.rlike(STANDARD_TEXT) if standards_mode == "pattern" else F.contains(name, F.lit(STANDARD_TEXT))
    return (
        F.when(F.contains(name, F.lit(HS_STANDARD)), F.lit(HS_STANDARD))
        .when(other, F.lit(OTHER_STANDARD))
        .otherwise(strip_last_token(name))
    )
