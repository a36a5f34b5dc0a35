"""Number parsing and text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.times import format_minute

# Text that counts as a number, and the words shown for missing values.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
NOT_AVAILABLE = "not available"
NO_NUMBER = "n/a"


def to_number(value: Column, dtype: T.DataType) -> Column:
    """Value as double, or NULL where it is no number. NaN counts as missing."""
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))
    number = value.try_cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nullif(number, F.lit(float("nan")))
    return number


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive substring test; the needle is no pattern."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def clean_text(value: Column) -> Column:
    return F.coalesce(F.replace(value.cast("string"), F.lit("\\"), F.lit("/")), F.lit(NOT_AVAILABLE))


def base_name(path: Column) -> Column:
    """Last component of a path with forward slashes; trailing slashes do not count."""
    return F.regexp_extract(F.regexp_replace(path, r"(/\.?)+\z", ""), r"([^/]*)\z", 1)


def _hundredths(frac: Column) -> Column:
    """A fraction below 1 in hundredths: the stored binary value, half to even.

    Scaled by a power of two the fraction is a whole number without loss, and a hundred of it fits in
    64 bits. Fractions below 1/16 have finer bits and get a larger scale; those that even this one
    cuts are below 0.004.
    """
    def scaled(bits: int) -> Column:
        hundred = F.floor(frac * F.lit(float(1 << bits))).cast("bigint") * 100
        whole, rest, half = F.shiftright(hundred, bits), hundred.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(1 << (bits - 1))
        up = (rest > half) | ((rest == half) & (whole % 2 == 1))
        return whole + up.cast("bigint")

    return F.when(frac < 1 / 16, scaled(60)).otherwise(scaled(56))


def format_2dp(value: Column) -> Column:
    """Two decimals, or ``n/a`` for NULL and NaN.

    The stored binary value is rounded, half to even, as C does: 0.125 gives 0.12 and 2.675, which is
    stored as a little less, 2.67. Beyond 2^53 there is nothing to round.
    """
    size = F.abs(value)
    small = size < float(1 << 53)
    inside = F.when(small, size).otherwise(F.lit(0.0))
    whole = F.floor(inside)
    cents = whole.cast("bigint") * 100 + _hundredths(inside - whole)
    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(sign, F.call_function("div", cents, F.lit(100).cast("bigint")).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(value.isNull() | F.isnan(value), F.lit(NO_NUMBER)).when(small, exact).otherwise(F.format_string("%.2f", value))


def summary_text(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), format_2dp(value))


def last_measured_text(name: Column, ts: Column) -> Column:
    """Newest file of a project and its minute; '' without a file name."""
    head = F.concat(F.lit("Last measured: "), name)
    return (
        F.when(name.isNull() | (name == ""), F.lit(""))
        .when(ts.isNull(), head)
        .otherwise(F.concat(head, F.lit(" Time: "), format_minute(ts)))
    )


def refreshed_text(updated_at: Column, new_rows: Column) -> Column:
    """Age of the data, with the number of rows gained when there are any."""
    head = F.concat(F.lit("Data refreshed "), format_minute(updated_at))
    gained = F.concat(head, F.lit(" · +"), new_rows.cast("string"), F.lit(" samples"))
    return F.when(new_rows > 0, gained).otherwise(head)
