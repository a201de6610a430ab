"""Fixed dimensions: four seasons with their coefficients, four cross-quarter days, four moon phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Coefficients of the published quartics (Meeus, Astronomical Algorithms, table 27.a) and the events' names.
SEASONS = [
    (0, "March Equinox", 2451623.80984, 365242.37404, 0.05169, -0.00411, -0.00057),
    (1, "June Solstice", 2451716.56767, 365241.62603, 0.00325, 0.00888, -0.00030),
    (2, "September Equinox", 2451810.21715, 365242.01767, -0.11575, 0.00337, 0.00078),
    (3, "December Solstice", 2451900.05952, 365242.74049, -0.06223, -0.00823, 0.00032),
]
#: Each lies half way between the season before it and the season of the same index.
CROSS_QUARTERS = [(0, "Imbolc"), (1, "Beltane"), (2, "Lughnasadh"), (3, "Samhain")]
#: Name and the phase that is crossed.
PHASES = [(0, "First Quarter", 0.25), (1, "Full Moon", 0.5), (2, "Last Quarter", 0.75), (3, "New Moon", 0.0)]


def seasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEASONS, "idx int, name string, a double, b double, c double, d double, e double")


def cross_quarters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CROSS_QUARTERS, "idx int, name string")
