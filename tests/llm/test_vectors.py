"""Hard-negative mining and whitening against brute force."""

import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ephemera.llm import hard_negatives, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    """Ties, repeated rows, copies of a hot vector, nulls of every kind, odd lengths, empty vectors, a null id."""
    rng = random.Random(3)
    make = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    out = [(k, make(), k % 3) for k in range(120)]
    hot = make()
    out += [(200 + k, hot, k % 2) for k in range(60)]  # ties
    out += [(5, out[5][1], 5 % 3), (10, out[10][1], 1), (10, out[10][1], 1)]  # repeated rows, an anchor's too
    odd = [(300, None, 1), (301, make(), None), (302, [], 1), (303, [0.5] * 5, 1), (304, [None] + make()[1:], 1), (305, [float("nan")] + make()[1:], 1), (306, [float("inf")] + make()[1:], 1), (None, make(), 1), (307, [0.0] * 6, 1), (308, [-x for x in hot], 2)]
    return out + odd


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({n: F.lit("x") for n in ("id", "row", "x", "b", "s", "k", "tie", "n", "component", "anchor", "score", "slot", "at", "d")})


def whole(rows, label=True):
    good = lambda v: v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)
    return [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int), b) for i, v, b in rows if good(v) and (not label or b is not None)]


def brute(rows, every, positives, negatives, low, high):
    told, out = whole(rows), []
    order = lambda e: (-e[1], 1 << 63 if e[0] is None else e[0])
    for k, (i, x, b) in enumerate(told):
        if i is None or i % every:
            continue
        rest = [(j, int(x @ y), c) for q, (j, y, c) in enumerate(told) if q != k]
        for j, p, _ in sorted((r for r in rest if r[2] == b), key=order)[:positives]:
            hard = sorted((r for r in rest if r[2] != b and low * p <= 100 * r[1] <= high * p), key=order)[:negatives]
            out += [(i, j, n, h, p, s) for n, (h, s, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "sets", "k"), [(2048, 8192, 10), (7, 3, 3), (40, 1, 1)])
def test_hard_negatives(frame, rows, monkeypatch, block, sets, k):
    monkeypatch.setattr(hard_negatives, "block_rows", lambda n: block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", sets)
    got = hard_negatives.mine(frame, "id % 10 = 0", negatives=k)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, 10, 5, k, 30, 90)
    assert sorted(map(tuple, got.collect()), key=str) == want and len({w[0] for w in want}) > 10


def test_hard_negatives_of_nothing(frame):
    assert hard_negatives.mine(frame.limit(0), "id % 10 = 0").count() == 0
    assert hard_negatives.mine(frame, "id < 0").count() == 0


def test_hard_negatives_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    want = con.execute(hard_negatives.OP11_SQL).df()
    got = hard_negatives.op11_hard_negatives(spark, sf_dir).toPandas()
    rows = lambda df: sorted(map(tuple, df[sorted(want.columns)].values.tolist()))
    assert rows(got) == rows(want) and len(want) > 100


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 25, 1 << 29):
        a, b = rng.integers(-top, top, (4, 6)), rng.integers(-top, top, (5, 6))
        assert hard_negatives.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for q in b] for r in a]


def test_best_takes_the_first_of_ties():
    score, at = np.array([5, 9, 5, 9, 5, 1]), np.arange(6)
    assert hard_negatives.best(score, at, 3).tolist() == [1, 3, 0]
    assert hard_negatives.best(score, at[:0], 3).tolist() == [] and hard_negatives.best(score, at, 9).tolist() == [1, 3, 0, 2, 4, 5]


def test_square_sums_are_exact():
    rng = np.random.default_rng(2)
    for top in (1, 1 << 20, 1 << 21, 1 << 42, 1 << 62):
        z = rng.integers(-top, top + 1, (50, 3))
        z[0] = top, -top, 0
        want = [sum(int(v) ** 2 for v in column) for column in z.T]
        assert list(whitening.square_sums(z)) == want == list(whitening.square_sums(z.astype(object)))
    assert list(whitening.square_sums(z[:0])) == [0, 0, 0]


def test_covariance_by_polarisation():
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 40), 1 << 40, (30, 4))
    n, sums = len(x), [int(s) for s in x.astype(object).sum(0)]
    y = whitening.centred(x, n, sums).astype(object)
    squares = {(i, j): int(((y[:, i] + y[:, j]) ** 2).sum()) if i < j else int((y[:, i] ** 2).sum()) for i in range(4) for j in range(i, 4)}
    want = [[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(4)] for i in range(4)]
    assert whitening.covariance(n, squares, 4).tolist() == want


def test_whitening(frame, rows):
    got = whitening.whiten(frame).toPandas()
    told = whole(rows, label=False)
    fit = np.unique(np.array([x for _, x, _ in told]), axis=0)
    n, sums, cov = len(fit), fit.sum(0), np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    want = sorted((str(i), k + 1, n, int(((n * x - sums) ** 2).sum())) for i, x, _ in told for k in range(4))
    same = lambda v: str(None) if v != v else str(int(v))
    assert sorted((same(i), *r) for i, *r in got[["vec_id", "component", "n", "deviation"]].itertuples(index=False)) == want
    for k in range(4):
        part = got[got["component"] == k + 1]
        mine = sorted((d, abs(w)) for d, w in zip(part["deviation"], part["whitened"], strict=True))
        other = sorted((int(((n * x - sums) ** 2).sum()), abs((x - sums / n) @ axes[:, -1 - k]) / values[-1 - k] ** 0.5) for _, x, _ in told)
        assert np.allclose(mine, other, rtol=1e-9, atol=1e-9)
        assert np.allclose(part["explained"], values[-1 - k] / np.trace(cov), rtol=1e-9)
        # One sign for all rows.
        by_id = part.dropna().drop_duplicates("vec_id").set_index("vec_id")["whitened"]
        ours = np.array([by_id[i] for i, _, _ in told if i is not None])
        theirs = np.array([(x - sums / n) @ axes[:, -1 - k] for i, x, _ in told if i is not None])
        assert abs(np.sign(ours) @ np.sign(theirs)) == len(ours)
    assert got["identity_error"].max() < 1e-9


def test_whitening_of_odd_tables(spark, frame):
    assert whitening.whiten(frame.limit(0)).count() == 0
    flat = spark.createDataFrame([(k, [1.0, 2.0, 3.0], 0) for k in range(3)], SCHEMA)
    got = whitening.whiten(flat).collect()
    assert len(got) == 9 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 0) for k in range(5)], SCHEMA)
    got = whitening.whiten(line).toPandas()
    assert got[got["component"] == 2]["whitened"].isna().all() and not got[got["component"] == 1]["whitened"].isna().any()
    # Beyond what a long holds: the covariances stay exact, a deviation is null.
    wide = spark.createDataFrame([(k, [k * 1e15, -k * 1e14, 1.0 * k], 0) for k in range(5)], SCHEMA)
    got = whitening.whiten(wide).toPandas()
    assert got["identity_error"].max() < 1e-6 and got[got["vec_id"] != 2]["deviation"].isna().all()


def test_matrix_of_a_slice():
    import pyarrow as pa

    column = pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int64())).slice(1)
    assert vectors.matrix(column, 2).tolist() == [[3, 4], [5, 6]]
