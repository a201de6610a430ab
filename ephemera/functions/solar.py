"""Sunrise and sunset from the published low-precision position of the sun, as steps over (day_ms, lat, lon).

The order of operations is kept as published, since it decides the last bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_half_up
from .steps import Step

DAY_MS = 86_400_000
RAD = math.pi / 180
#: Fixed values of the published formulas.
OBLIQUITY = RAD * 23.4397
J2000, J1970, J0 = 2451545, 2440588, 0.0009
PERIHELION = RAD * 102.9372
HORIZON = RAD * -0.833


def days(ms: Column) -> Column:
    """Days since J2000."""
    return ms / F.lit(float(DAY_MS)) - 0.5 + J1970 - J2000


def mean_anomaly(d: Column) -> Column:
    return RAD * (357.5291 + 0.98560028 * d)


def ecliptic_longitude(m: Column) -> Column:
    centre = RAD * (1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m))
    return m + centre + PERIHELION + math.pi


def transit(x: Column, m: Column, lng: Column) -> Column:
    return J2000 + x + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * lng)


def julian_ms(j: Column) -> Column:
    """Epoch milliseconds, truncated towards zero."""
    return ((j + 0.5 - J1970) * float(DAY_MS)).cast("bigint")


#: cosw is outside -1..1 on days without sunrise and sunset; w and both instants are null then.
STEPS: list[Step] = [
    ("lw", lambda e: RAD * (-e["lon"])),
    ("phi", lambda e: RAD * e["lat"]),
    ("d", lambda e: days(e["day_ms"])),
    ("n", lambda e: round_half_up(e["d"] - J0 - e["lw"] / (2 * math.pi)).cast("double")),
    ("ds", lambda e: J0 + e["lw"] / (2 * math.pi) + e["n"]),
    ("m", lambda e: mean_anomaly(e["ds"])),
    ("lng", lambda e: ecliptic_longitude(e["m"])),
    ("dec", lambda e: F.asin(math.sin(OBLIQUITY) * F.sin(e["lng"]))),
    ("cosw", lambda e: (math.sin(HORIZON) - F.sin(e["phi"]) * F.sin(e["dec"])) / (F.cos(e["phi"]) * F.cos(e["dec"]))),
    ("w", lambda e: F.when(e["cosw"].between(-1.0, 1.0), F.acos(e["cosw"]))),
    ("noon", lambda e: transit(e["ds"], e["m"], e["lng"])),
    ("set", lambda e: transit(J0 + (e["w"] + e["lw"]) / (2 * math.pi) + e["n"], e["m"], e["lng"])),
    ("rise_ms", lambda e: julian_ms(e["noon"] - (e["set"] - e["noon"]))),
    ("set_ms", lambda e: julian_ms(e["set"])),
]
