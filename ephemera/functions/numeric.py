"""Number handling with the rules of the calendar's identifiers: rounding, parsing and shortest decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def round_half_up(x: Column) -> Column:
    """Nearest integer, ties towards positive infinity; round() would send -0.5 to -1."""
    return F.floor(x + 0.5)


def parse_number(text: Column) -> Column:
    """Decimal text as double, else null. Empty text, hexadecimal, NaN, Infinity and suffixes such as 12d are not numbers."""
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def number_text(x: Column) -> Column:
    """Shortest decimal text of a double: 5, -41.27, 0.0005, 1e-7; both zeros are 0."""
    size, plain = F.abs(x), x.cast("string")
    small = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,26)").cast("string"), "0+$", ""), r"\.$", "")
    tiny = F.regexp_replace(F.lower(plain), r"\.0e", "e")
    return F.when(x == 0, "0").when(size < 1e-6, tiny).when(size < 1e-3, small).otherwise(F.regexp_replace(plain, r"\.0$", ""))
