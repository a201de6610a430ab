"""Operator 13, embedding whitening: covariances by polarisation, from exact squares of dimensions and of sums of two, then eigh."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import matrix, of_usual_length, usable, whole

COMPONENTS = 4
#: Bits of the parts into which numbers are split before they are squared, and rows that are summed at a time: such sums fit in 64 bits.
PART, ROWS = 21, 4096
TOTALS = "i int, total decimal(38,0)"
SQUARES = "i int, j int, total decimal(38,0)"
PROJECTED = "id long, deviation long, whitened array<double>"


def square_sums(z: np.ndarray) -> np.ndarray:
    """Sum of the squares of each column, exact, as Python integers. z: integers of any size; int64 ones at most ROWS at a time."""
    if z.dtype == object:
        return (z * z).sum(0) if len(z) else np.zeros(z.shape[1], object)
    top = int(np.abs(z).max(initial=0))
    parts = []
    for _ in range(top.bit_length() // PART):
        parts.append(z & ((1 << PART) - 1))
        z = z >> PART
    parts.append(z)  # with the sign
    total = np.zeros(z.shape[1], object)
    for a, x in enumerate(parts):
        for b in range(a, len(parts)):
            total += (x * parts[b]).sum(0).astype(object) << (PART * (a + b) + (a < b))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: int64 where sums of two of them fit, else Python integers."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums))
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _rows(names: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "decimal(38,0)": pa.decimal128(38, 0)}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([Decimal(int(v)) for v in c] if k[0] == "d" else c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _totals(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """A task's sum of every dimension; halves keep the sums within 64 bits."""
    total = np.zeros(d, object)
    for batch in batches:
        x = matrix(batch.column(0), d)
        total += ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
    yield _rows(TOTALS, [list(range(d)), list(total)])


def _squares(batches: Iterator[pa.RecordBatch], d: int, n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    """A task's sums of squared centred values: (i, i) of dimension i, (i, j) of the sum of dimensions i and j."""
    total = [np.zeros(d - i, object) for i in range(d)]
    for batch in batches:
        whole_batch = matrix(batch.column(0), d)
        for at in range(0, len(whole_batch), ROWS):
            y = centred(whole_batch[at : at + ROWS], n, sums)
            for i in range(d):
                total[i][0] += square_sums(y[:, i : i + 1])[0]
                if i + 1 < d:
                    total[i][1:] += square_sums(y[:, i + 1 :] + y[:, i : i + 1])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    yield _rows(SQUARES, [[i for i, _ in pairs], [j for _, j in pairs], [v for t in total for v in t]])


def _project(batches: Iterator[pa.RecordBatch], d: int, n: int, sums: list[int], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """axes: a column per component, divided by the root of its eigenvalue; NaN stands for no spread."""
    for batch in batches:
        y = centred(matrix(batch.column(1), d), n, sums)
        fits = y.dtype != object and d * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63
        deviation = (y * y).sum(1) if fits else [v if v < 1 << 63 else None for v in map(int, (y.astype(object) ** 2).sum(1))]
        found = (y.astype(np.float64) / n) @ axes
        flat = pa.array(found.ravel(), pa.float64(), from_pandas=True)  # NaN as null
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * axes.shape[1], pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "whitened"])


def covariance(n: int, squares: dict[tuple[int, int], int], d: int) -> np.ndarray:
    """The covariance matrix (divisor n) from sums of squares of n * x - S, each entry rounded once from its exact value.

    Polarisation: the squares of a sum of two dimensions less those of either are twice the sum of products.
    """
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = squares[i, i] / n**3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) // 2 / n**3
    return out


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component, numbered from 1 by falling eigenvalue, up to `components` and the dimension.

    (id, component, n, deviation, whitened, explained, identity_error). Entries become x = floor(256 * c); n, the sums S and all covariances are of
    the list of distinct x vectors. deviation: sum over dimensions of (n * x - S)**2, exact, null where a long cannot hold it. whitened: (x - S / n)
    on the component, over the root of its eigenvalue. explained: eigenvalue over trace. identity_error: largest absolute entry of whitened's
    covariance over the list, less the identity.

    Tasks return the sums of squares of their rows, d * (d + 1) / 2 numbers for d dimensions, added up in Spark; these, and nothing that grows with the
    rows, reach the driver. Values of any size are added exactly.

    Rows drop out whose vector is null, empty, of another length than most, or holds null or non-finite entries. A component without spread (its
    eigenvalue is rounding, as when all vectors are equal) has whitened null and no part in identity_error; explained is null where nothing has
    spread. Repeated rows and ids and null ids are returned each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    vector = F.col(vector_col)
    told = rows.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), whole(vector).alias("x"))
    kept, d = of_usual_length(told, "x")
    if not d:
        return spark.createDataFrame([], f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit = scratch.save(kept.select("x").distinct())
    n = fit.count()
    added = fit.mapInArrow(partial(_totals, d=d), TOTALS).groupBy("i").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    totals = {r["i"]: int(r["total"]) for r in added}
    sums = [totals[i] for i in range(d)]
    added = fit.mapInArrow(partial(_squares, d=d, n=n, sums=sums), SQUARES).groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    cov = covariance(n, {(r["i"], r["j"]): int(r["total"]) for r in added}, d)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    k, trace = len(values), float(np.trace(cov))
    spread = values > d * np.finfo(float).eps * trace
    axes = vectors / np.sqrt(np.where(spread, values, np.nan))

    project = partial(_project, d=d, n=n, sums=sums, axes=axes)
    at = fit.select(F.lit(0).cast("long").alias("id"), "x").mapInArrow(project, PROJECTED)
    pairs = [(i, j) for i in range(k) for j in range(i, k) if spread[i] and spread[j]]
    error = None
    if pairs:
        got = at.agg(*(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*(F.lit(max(0.0, float(v)) / trace if trace else None).cast("double") for v in values))
    done = kept.mapInArrow(project, PROJECTED).select("id", "deviation", F.posexplode("whitened").alias("k", "w"))
    return done.select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("w").alias("whitened"),
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
