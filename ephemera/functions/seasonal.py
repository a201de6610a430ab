"""Season instants: a quartic in the year for each equinox and solstice, and the conversion of Julian ephemeris days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_jde(year: Column, a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """Good to 5 to 15 minutes: the periodic terms are left out."""
    y = (year - 2000) / F.lit(1000.0)
    return a + b * y + c * F.pow(y, F.lit(2.0)) + d * F.pow(y, F.lit(3.0)) + e * F.pow(y, F.lit(4.0))


def jde_ms(jde: Column) -> Column:
    """Epoch milliseconds, truncated; the 69 s between terrestrial and universal time are neglected."""
    return ((jde - 2440587.5) * 86400000.0).cast("bigint")
