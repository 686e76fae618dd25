"""Null-aware scalar rules shared by the operators.

The original analysis ran on pandas; its comparison, strip and null-token
behaviour differs from Spark's defaults.  Each helper here pins the intended
behaviour with built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

# The spellings of "missing" in a CSV export, exactly as they stand in a cell.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Accepted timestamp layouts, tried in order.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_tokens_to_null(x, tokens=NULL_TOKENS) -> Column:
    """Map CSV null spellings to real nulls (pandas reads them as missing)."""
    col = c(x)
    return F.when(col.isin(list(tokens)), F.lit(None).cast(StringType())).otherwise(col)


def parse_timestamp(x, data_type: DataType | None = None, formats=TIMESTAMP_FORMATS) -> Column:
    """Unparseable text becomes null (never an exception); result is timestamp_ntz."""
    col = c(x)
    if data_type is not None and not isinstance(data_type, StringType):
        return col.cast("timestamp_ntz")
    attempts = [F.try_to_timestamp(col, F.lit(f)) for f in formats]
    return F.coalesce(*attempts).cast("timestamp_ntz")


def shift_minutes(ts, minutes: int) -> Column:
    return c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)), F.lit(0))


def minutes_between(start, end) -> Column:
    """Fractional minutes from start to end; negative when end precedes start."""
    return F.timestamp_diff("MICROSECOND", c(start), c(end)) / F.lit(60_000_000.0)


def coalesce_false(pred: Column) -> Column:
    """A comparison with a missing side is False (pandas ``>`` semantics)."""
    return F.coalesce(pred, F.lit(False))


def coalesce_true(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(True))


def differs(a, b) -> Column:
    """pandas ``Series.ne``: True when either *or both* sides are missing."""
    return coalesce_true(c(a) != c(b))


def ratio(num, den) -> Column:
    """Null when the denominator is zero or missing (never raises)."""
    return F.try_divide(c(num).cast("double"), c(den).cast("double"))


def strip_ws(x) -> Column:
    """Python ``str.strip``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")
