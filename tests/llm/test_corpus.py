"""Quality, mixing, packing and the pipeline, against brute force; op1 and op8 against SQL."""

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ephemera.llm import catalog, mixing, packing, quality


def test_quality_of_rows_it_never_saw(spark):
    """Fitted on one table, scored on another."""
    train, other = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
    model = quality.fit(spark.read.parquet(f"{train}/documents.parquet"), spark.read.parquet(f"{train}/labels.parquet"))
    got = quality.score(spark.read.parquet(f"{other}/documents.parquet"), model).select("doc_id", "score").toPandas()
    known = pd.read_parquet(f"{other}/labels.parquet").merge(got, on="doc_id")
    kept = known["score"] >= quality.KEEP
    assert kept[known["quality"] == 1].mean() > 0.999
    assert kept[known["quality"] == 0].mean() < 0.05


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = catalog.QUERIES["op2_quality"](spark, sf)
    assert got.columns == ["doc_id", "source", "lang", "doc_score", "host_posterior", "path_posterior", "score", "kept"]
    known = pd.read_parquet(f"{sf}/labels.parquet").merge(got.toPandas(), on="doc_id")
    unseen = known[[zlib.crc32(str(i).encode()) % 5 == 0 for i in known["doc_id"]]]
    assert len(unseen) > 500
    assert unseen["kept"][unseen["quality"] == 1].mean() > 0.999
    assert unseen["kept"][unseen["quality"] == 0].mean() < 0.05


def strength(groups, means):
    """groups: lists of scores; the prior strength by the method of moments."""
    n, mu = sum(map(len, groups)), sum(map(sum, groups)) / sum(map(len, groups))
    between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, means, strict=True))
    inside = sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g in groups)
    spread = max(inside, 1e-9) / max(n - len(groups), 1)
    effective = (n - sum(len(g) ** 2 for g in groups) / n) / (len(groups) - 1)
    variance = max((between / (len(groups) - 1) - spread) / max(effective, 1.0), 1e-6)
    mu = min(max(mu, 1e-4), 1 - 1e-4)
    return min(max(mu * (1 - mu) / variance - 1, 1.0), 1e4)


def test_posteriors_equal_brute_force_and_shrink_sparse_sites(spark):
    rng = random.Random(3)
    good, bad = "plain words in a row here", "BAD%%% NEWS&&& | | | !!!! %%%"
    rows = [(k, good if rng.random() < (0.9 if k % 4 else 0.3) else bad, "p" + str(k % 3), "host" + str(k % 4)) for k in range(400)]
    rows += [(1000, good, None, "rare"), (1001, bad, None, None), (1002, None, "p", "rare"), (1002, None, "p", "rare"), (1003, "", "p", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.where("doc_id < 100").select("doc_id", (F.col("text") == good).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    assert np.allclose(got["doc_score"], [sigmoid(model.logit(t)) for t in got["text"]])
    at = [(r.source or "", r.lang or "") for r in got.itertuples()]
    p = list(got["doc_score"])
    mu = sum(p) / len(p)
    hosts, paths = {}, {}
    for (h, w), x in zip(at, p, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, w), []).append(x)
    a = strength(list(hosts.values()), [mu] * len(hosts))
    b = strength(list(paths.values()), [sum(hosts[h]) / len(hosts[h]) for h, _ in paths])
    for (h, w), x, r in zip(at, p, got.itertuples(), strict=True):
        host = (sum(hosts[h]) - x + a * mu) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, w]) - x + b * host) / (len(paths[h, w]) - 1 + b)
        logit = lambda y: math.log(y / (1 - y))
        want = sigmoid(logit(x) + logit(path) - logit(mu))
        assert (r.host_posterior, r.path_posterior, r.score) == pytest.approx((host, path, want), rel=1e-9)
    for h in ("rare", ""):
        assert abs(got["host_posterior"][[x[0] == h for x in at]].mean() - mu) < abs(sum(hosts[h]) / len(hosts[h]) - mu)


def test_document_evidence_equals_brute_force(monkeypatch):
    weights = np.arange(quality.GRAMS) / 1000 - 2
    text = "Was it it it a cat?  Ä\tcat? was " * 3
    data, words = text.encode(), text.split()
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    runs = [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B1 % 2**32) >> 20 for i in range(len(data) - 2)]
    want = (sum(weights[r] for r in runs) / len(runs), sum(x == y for x, y in itertools.pairwise(low)) / len(low), len(set(low)) / len(low) ** 0.75, math.log1p(len(low)))
    assert quality.features(text, weights) == pytest.approx(want)
    assert quality.features(None, weights) == quality.features("", weights) == (0.0, 0.0, 1.0, 0.0)
    monkeypatch.setattr(quality, "BLOCK", 7)  # a long text is hashed in blocks
    assert quality.features(text, weights) == pytest.approx(want)


def test_quality_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert quality.score(docs, model).where("score < 0.5").count() == 0
    assert quality.score(empty, model).count() == 0


TOKENS = {"a": 1000.0, "b": 100.0, "c": 10.0}


def weights_for(tokens, exponent):
    raised = {s: (n / sum(tokens.values())) ** exponent for s, n in tokens.items()}
    return {s: r / sum(raised.values()) for s, r in raised.items()}


def best_exponent(tokens, target):
    """By a fine search, without the module."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        w = weights_for(tokens, mid)
        if target.entropy is not None:
            low, high = (mid, high) if -sum(x * math.log(x) for x in w.values()) >= target.entropy else (low, mid)
        else:
            ratio = [w[s] / tokens[s] for s in tokens]
            low, high = (low, mid) if max(ratio) / min(ratio) <= target.repeats else (mid, high)
    return low if target.entropy is not None else high


def test_exponents(spark):
    exponent = lambda tokens, target: mixing.bisect_exponent(spark.createDataFrame(list(tokens.items()), "s string, t double"), target)
    keep = exponent(TOKENS, mixing.Target(repeats=2))
    assert math.isclose(keep, 1 - math.log(2) / math.log(100), abs_tol=1e-9) and math.isclose(keep, best_exponent(TOKENS, mixing.Target(repeats=2)), abs_tol=1e-9)
    half = exponent(TOKENS, mixing.Target(entropy=0.8))
    w = weights_for(TOKENS, half)
    assert math.isclose(-sum(x * math.log(x) for x in w.values()), 0.8, abs_tol=1e-9)
    assert exponent(TOKENS, mixing.Target(entropy=99)) == 0
    assert exponent(TOKENS, mixing.Target(entropy=0)) == exponent(TOKENS, mixing.Target(repeats=1)) == 1
    assert exponent({"a": 5.0}, mixing.Target(repeats=1)) == 1
    with pytest.raises(ValueError, match="either"):
        exponent(TOKENS, mixing.Target())


@pytest.mark.parametrize("target", [mixing.Target(repeats=3), mixing.Target(entropy=0.9)])
def test_mix_meets_its_weights_and_loses_nothing(spark, target):
    rng = random.Random(5)
    sources = ["big"] * 6000 + ["mid"] * 1200 + ["low"] * 600 + [None] * 300
    rows = [(k, " ".join("w" for _ in range(rng.randint(1, 30))) or None, s) for k, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("s", F.lit(1))
    got = mixing.mix(docs, target).toPandas()
    assert list(got.columns) == [*docs.columns, "mix_epoch", "mix_block", "mix_at", "mix_tokens"]
    assert set(got["doc_id"]) == set(range(len(rows))) and not got.duplicated(["doc_id", "mix_epoch"]).any()
    got["source"] = got["source"].fillna("")
    one = got[got["mix_epoch"] == 0].groupby("source")["mix_tokens"].sum()
    tokens = {s: float(n) for s, n in one.items()}
    want = weights_for(tokens, best_exponent(tokens, target))
    have = got.groupby("source")["mix_tokens"].sum()
    for s, w in want.items():
        assert abs(have[s] / have.sum() - w) < 0.02
    if target.repeats:
        assert (have / one)[""] == pytest.approx(3, rel=0.1) and (have / one)["big"] == 1
    for low in (0.0, 0.25, 0.5, 0.75):  # the weights hold in every stretch
        part = got[got["mix_at"].between(low, low + 0.25)].groupby("source")["mix_tokens"].sum()
        assert abs(part["big"] / part.sum() - want["big"]) < 0.06
    order = [tuple(got[(got["source"] == "mid") & (got["mix_epoch"] == e)].sort_values("mix_at")["doc_id"]) for e in (0, 1)]
    assert order[0] != order[1]
    # Every epoch of a source has its blocks one after another, each once.
    for (_, _), part in got.groupby(["source", "mix_epoch"]):
        blocks = [b for b, _ in itertools.groupby(part.sort_values("mix_at")["mix_block"])]
        assert len(blocks) == len(set(blocks))


@pytest.mark.parametrize("target", [mixing.Target(repeats=3), mixing.Target(entropy=1.0)])
def test_mix_of_more_sources_than_are_broadcast(spark, monkeypatch, target):
    rows = [(k, "w " * (1 + k % 7), f"s{int(k**0.3)}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    read = lambda: sorted((r["doc_id"], r["mix_epoch"], r["mix_block"], round(r["mix_at"], 6)) for r in mixing.mix(docs, target).collect())
    want = read()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert read() == want


def test_mix_of_odd_tables(spark, docs, empty, corpus):
    got = mixing.mix(docs, mixing.Target(repeats=1))
    assert got.count() == len(corpus)
    assert mixing.mix(empty, mixing.Target(repeats=2)).count() == 0
    long = spark.createDataFrame([(1, "a\tb " * 500_000, "s"), (2, None, "s"), (None, " ", None)], "doc_id long, text string, source string")
    assert sorted(r["mix_tokens"] for r in mixing.mix(long, mixing.Target(repeats=2)).where("mix_epoch = 0").collect()) == [1, 1, 1_000_000]


def best_possible(lengths, most):
    """Fewest bins, by trying all partitions."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i, b in enumerate(bins):
            if b + lengths[k] <= most and b not in bins[:i]:
                go(k + 1, [*bins[:i], b + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


def test_each_bin_is_as_full_as_it_can_be():
    rng = random.Random(1)
    for _ in range(60):
        most = rng.randint(8, 30)
        lengths = [rng.randint(1, most) for _ in range(rng.randint(1, 9))]
        left = {x: lengths.count(x) for x in lengths}
        plan = packing.plan_bins(left, most)
        used = sorted(x for b, n in plan for x in b * n)
        assert used == sorted(lengths)
        assert all(sum(b) <= most for b, _ in plan)
        first = plan[0][0]
        rest = list(lengths)
        rest.remove(first[0])
        fullest = max(sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if sum(c) <= most - first[0])
        assert first[0] == max(lengths) and sum(first) == first[0] + fullest
        assert sum(n for _, n in plan) <= best_possible(lengths, most) + 1


def test_plan_of_many_pieces_is_short():
    counts = {x: 10**9 // x for x in range(1, 2049)}
    plan = packing.plan_bins(counts)
    assert sum(n * sum(b) for b, n in plan) == sum(k * v for k, v in counts.items())
    assert sum(n for _, n in plan) <= -(-sum(k * v for k, v in counts.items()) // 2048) + len(counts)
    assert len(plan) < 20_000


def test_packing(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(400, "a<|endoftext|>b  c\n\n d \t"), (401, "x" * 20_000), (402, "<|endoftext|>")]
    rows = docs.select("doc_id", "text", "piece" if "piece" in docs.columns else F.lit(9).alias("piece")).unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumn("piece", F.lit(9)))
    got = packing.pack(rows).toPandas()
    want = sorted(tuple([*encode.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in corpus + extra)
    assert got["length"].sum() == sum(map(len, want))
    by_doc = {i: np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in corpus + extra}
    for r in got.itertuples():
        assert zlib.crc32(by_doc[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, pieces in got[got["doc_id"] != 309].groupby("doc_id"):
        pieces = pieces.sort_values("piece")
        lengths = list(pieces["length"])
        assert list(pieces["piece"]) == list(range(len(pieces))) and lengths[1:] == [2048] * (len(lengths) - 1)
        assert list(pieces["start"]) == [0, *np.cumsum(lengths)[:-1]] and sum(lengths) == len(by_doc[i])
    assert (got["doc_id"] == 309).sum() == 2  # repeated rows
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq["offset"]) == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1


def test_packing_of_long_runs(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 3_000_000, "\n" * 1_000_000 + "end", "a" + " \n\t" * 400_000 + "b", "x" * 300_000, "0" * 100_000, "é" * 50_000 + "!" * 50_000]
    for text in texts:
        assert packing.token_ids(text).tolist() == encode.encode(text, add_special_tokens=False).ids
    # Parts of a length keep ranks apart.
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 3)) for k in range(100)], "doc_id long, text string")
    got = packing.pack(docs, most=5).toPandas()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq["offset"]) == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 5
    assert len(got[got["piece"] == 0]) == 100


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(repr, df[sorted(want.columns)].values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_runs_by_its_own_columns(spark, name):
    """On the smallest tables; rows and first columns as the contracts have them."""
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES[name](spark, sf)
    known = {
        "op4_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op7_line_dedup": ["doc_id", "n_lines", "n_dropped", "n_chars_left", "left_sha256"],
        "op9_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op11_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
        "op12_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op13_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    }
    assert got.columns == known.get(name, got.columns)
    first, source = got.columns[0], {"op8_chat_format": "conversations", "op11_hard_negatives": "embeddings", "op13_whitening": "embeddings"}.get(name, "documents")
    docs = spark.read.parquet(f"{sf}/{source}.parquet")
    if name == "op11_hard_negatives":
        docs = docs.where("vec_id % 100 = 0").withColumnRenamed("vec_id", first)
    assert got.select(first).distinct().count() == docs.select(first).distinct().count() + (name == "op8_chat_format")


def test_pipeline_of_odd_tables(spark, tmp_path, corpus):
    """Nulls, empty texts, repeated rows and a long text; then no rows at all."""
    import corpus_pipeline as pipeline

    rows = [(i, t, None if i is None or i % 3 else "en", None if i is None or i % 4 else "s", None) for i, t in [*corpus, (None, "no id"), (None, None)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("some", frame), ("none", frame.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").toPandas()
        assert (len(got) > 0) == (name == "some")
        if len(got):
            assert got.groupby("sequence_id")["length"].sum().max() <= 2048 and {302, 303} <= set(got["doc_id"].dropna())


def test_pipeline(spark, sf_dir):
    """Each stage's decisions, from what its predecessor kept."""
    import corpus_pipeline as pipeline
    from test_dedup import lines_left, near

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        path = pipeline.Scratch(spark).save(made)
        seen.append(path.toPandas())
        docs = path
    start, good, lines, near_kept, mixed, packed = seen
    for df in seen[:-1]:
        assert sorted(df.columns) == sorted(start.columns)
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet").merge(start, on="doc_id")
    gone = set(start["doc_id"]) - set(good["doc_id"])
    assert set(labels[labels["quality"] == 1]["doc_id"]).isdisjoint(gone) and gone
    left = dict(lines_left(list(zip(good["doc_id"], good["text"], strict=True))))
    want = {i: t for i, t in left.items() if t.strip() or not start.set_index("doc_id")["text"][i].strip()}
    assert dict(zip(lines["doc_id"], lines["text"], strict=True)) == want
    assert (lines["n_chars"] == lines["text"].str.len()).all()
    parts = near(list(zip(lines["doc_id"], lines["text"], strict=True)), pipeline.NEAR_WIDTH)
    assert set(near_kept["doc_id"]) == {i for i, (_, c) in parts.items() if i == c}
    assert set(mixed["doc_id"]) == set(near_kept["doc_id"]) and mixed.groupby("doc_id").size().max() <= 2
    assert packed[packed["piece"] == 0].groupby("doc_id").size().to_dict() == mixed.groupby("doc_id").size().to_dict()
    whole = pipeline.run(spark, sf_dir)
    assert whole.select("doc_id", "piece", "length", "ids_crc32").exceptAll(spark.createDataFrame(packed[["doc_id", "piece", "length", "ids_crc32"]], "doc_id long, piece int, length long, ids_crc32 long")).count() == 0
