"""The moon's phase from published low-precision positions of sun and moon, as steps over an instant in epoch milliseconds.

0 is new moon, 0.25 first quarter, 0.5 full moon, 0.75 last quarter. The phase is ill-conditioned near 0 and 0.5: compare it rounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .solar import OBLIQUITY, RAD, days, ecliptic_longitude, mean_anomaly
from .steps import Step

#: Kilometres (fixed value).
SUN_DISTANCE = 149598000.0


def _ascension(lng: Column, lat: Column) -> Column:
    return F.atan2(F.sin(lng) * math.cos(OBLIQUITY) - F.tan(lat) * math.sin(OBLIQUITY), F.cos(lng))


def _declination(lng: Column, lat: Column) -> Column:
    return F.asin(F.sin(lat) * math.cos(OBLIQUITY) + F.cos(lat) * math.sin(OBLIQUITY) * F.sin(lng))


STEPS: list[Step] = [
    ("d", lambda e: days(e["ms"])),
    ("lng", lambda e: ecliptic_longitude(mean_anomaly(e["d"]))),
    ("sdec", lambda e: _declination(e["lng"], F.lit(0.0))),
    ("sra", lambda e: _ascension(e["lng"], F.lit(0.0))),
    ("mm", lambda e: RAD * (134.963 + 13.064993 * e["d"])),
    ("ml", lambda e: RAD * (218.316 + 13.176396 * e["d"]) + RAD * 6.289 * F.sin(e["mm"])),
    ("mb", lambda e: RAD * 5.128 * F.sin(RAD * (93.272 + 13.229350 * e["d"]))),
    ("dist", lambda e: 385001 - 20905 * F.cos(e["mm"])),
    ("mdec", lambda e: _declination(e["ml"], e["mb"])),
    ("mra", lambda e: _ascension(e["ml"], e["mb"])),
    ("apart", lambda e: e["sra"] - e["mra"]),
    ("p", lambda e: F.acos(F.sin(e["sdec"]) * F.sin(e["mdec"]) + F.cos(e["sdec"]) * F.cos(e["mdec"]) * F.cos(e["apart"]))),
    ("inc", lambda e: F.atan2(SUN_DISTANCE * F.sin(e["p"]), e["dist"] - SUN_DISTANCE * F.cos(e["p"]))),
    ("ang", lambda e: F.atan2(F.cos(e["sdec"]) * F.sin(e["apart"]), F.sin(e["sdec"]) * F.cos(e["mdec"]) - F.cos(e["sdec"]) * F.sin(e["mdec"]) * F.cos(e["apart"]))),
    ("phase", lambda e: 0.5 + 0.5 * e["inc"] * F.when(e["ang"] < 0, -1.0).otherwise(1.0) / math.pi),
]
