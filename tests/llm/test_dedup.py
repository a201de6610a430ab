"""Exact, near and line dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ephemera.llm import common, components, exact_dedup, line_dedup, near_dedup


class Union:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def exact(corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out)


def test_exact_dedup(docs, corpus):
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == exact(corpus)


def test_exact_dedup_tells_colliding_texts_apart(docs, corpus):
    weak = exact_dedup.exact_dedup(docs, content_hash=lambda norm: F.length(norm) % 3)
    assert sorted(map(tuple, weak.collect())) == exact(corpus)


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def near(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    union = Union(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_components(docs, corpus, width):
    got = near_dedup.near_components(docs, width=width).collect()
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near(corpus, width)


def test_near_components_lose_no_link_between_the_rays_of_a_star(spark, words):
    """A chain of drifting copies: neighbours are linked, but hardly any is linked with the first."""
    text = [words[k % 400] for k in range(150)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(text)))
        text[(7 * i) % 150] = f"new{i}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(frame, width=4).collect()}
    assert got == near(rows, 4)


@pytest.mark.parametrize(("rows", "shingles"), [(8, 1 << 21), (256, 1500), (256, 1 << 21)])
def test_rays_are_compared_in_blocks(spark, words, monkeypatch, rows, shingles):
    """A group in which each document is a component of its own: all links with one end out are found, whatever bounds the blocks."""
    from functools import partial

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    text, docs = [words[k % 400] for k in range(150)], []
    for i in range(60):
        docs.append((i, " ".join(text)))
        text[(7 * i) % 150] = f"new{i}"
    docs += [(100 + i, " ".join(f"{words[k]}{i}" for k in range(90))) for i in range(20)]  # like nothing
    frame = spark.createDataFrame(docs, "id long, text string")
    scratch = near_dedup.Scratch(spark)
    classes = scratch.save(frame.mapInArrow(partial(near_dedup._sign, width=4), near_dedup.SIGNED).select("id", "n", "bins"))
    linker = near_dedup._Linker(frame, classes, scratch, 4, near_dedup.SHARE)
    linker.gather(frame.select("id"))
    groups = scratch.save(frame.selectExpr("0L AS hub", "id", "id AS own", "id % 3 = 0 AS out"))
    some = {r["id"] for r in linker.with_partners(groups).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in docs}
    linked = lambda x, y: 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    want = {(x, y) for x in sets for y in sets if x % 3 == 0 and x != y and linked(x, y)}
    assert {tuple(r) for r in linker.rest(groups).collect()} == want and len(want) > 100
    assert {i for pair in want for i in pair} <= some and not any(i >= 100 for i in some)


def test_near_components_of_nothing(empty):
    assert near_dedup.near_components(empty).count() == 0


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(5, 4), (4, 5), (9, 9), (7, 8), (8, 3)], []])
def test_connected_components(spark, edges):
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    union = Union(nodes)
    for a, b in edges:
        if a != b:
            union.join(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").union(spark.sql("select null, 1L")))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: union.find(x) for x in nodes}


def lines_left(rows, width=line_dedup.WIDTH, similar=line_dedup.TENTHS / 10):
    clean = lambda x: x.strip(" \t\r")
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for at, raw in enumerate((t or "").split("\n")):
            if clean(raw):
                first[clean(raw)] = min(first.get(clean(raw), (i, at)), (i, at))
    sets = {x: {x[k : k + width] for k in range(len(x) - width + 1)} or {x} for x in first}
    order = sorted(first, key=first.get)
    union = Union(range(len(order)))
    for k, a in enumerate(order):
        for m in range(k + 1, len(order)):
            both = len(sets[a] & sets[order[m]])
            if both and both >= similar * len(sets[a] | sets[order[m]]):
                union.join(k, m)
    keep = {x: first[order[union.find(k)]] for k, x in enumerate(order)}
    return sorted((i, "\n".join(raw for at, raw in enumerate((t or "").split("\n")) if not clean(raw) or keep[clean(raw)] == (i, at))) for i, t in rows)


def test_line_dedup(docs, corpus):
    rows = [(i, t if t is None or i % 2 else re.sub(r"((?:\S+ ){9}\S+) ", r"\1\n", t)) for i, t in corpus]
    extra = docs.drop("text").dropDuplicates(["doc_id"]).join(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    got = line_dedup.dedup_lines(extra)
    assert set(extra.columns) | {"n_lines", "n_dropped"} == set(got.columns)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == lines_left(rows)


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def kept_lines(spark, lines):
    """Whether each of the lines, that are all in one document and none of which is empty, stays."""
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()["text"].split("\n")
    return [x in set(got) for x in lines]


def test_line_dedup_of_long_lines_without_spaces(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789,") for _ in range(n))
    lines, stays = [], []
    for k in range(30):
        bare, tabbed, label = make(500), "\t".join(make(9) for _ in range(60)), f"{make(4)} {make(600)}"
        for x, y in ((bare, f"#{bare[1:]}"), (tabbed, f"{make(9)}{tabbed[9:]}"), (label, f"{make(4)}{label[4:]}")):
            lines += [x, y]
            stays += [True, False]
    assert kept_lines(spark, lines) == stays


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).replace(" ", "_")
    lines, stays = [], []
    for k in range(900):
        n = 4 + k % 30  # distinct shingles of the shorter line; n / (n + n // 4) is 0.8 or more
        line = make(n + line_dedup.WIDTH - 1)
        lines += [line, line + make(n // 4)]
        stays += [True, False]
    assert kept_lines(spark, lines) == stays


def test_line_dedup_of_repetitive_lines(spark):
    pairs = [("-" * 250, "-" * 400), ("na " * 40, "na " * 200), ("buy one, get one free! " * 9, "buy one, get one free! " * 40)]
    assert kept_lines(spark, [x.strip() for pair in pairs for x in pair]) == [True, False] * 3


def test_hashes_and_maps_of_lines(spark):
    lines = ["", "short", "exactly12chr", "a" * 30, "日本😀" * 9, "the same words and the same words again, " * 40]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sets = {i: [line[k : k + 12] for k in range(max(1, len(line) - 11))] for i, line in enumerate(lines)}
    got = {r["id"]: r["h"] for r in df.select("id", line_dedup._hashes("line").alias("h")).collect()}
    assert {i: (len(h), len(set(h))) for i, h in got.items()} == {i: (len(s), len(set(s))) for i, s in sets.items()}  # before: distinct ones only, by a regex
    maps = line_dedup._maps(df.select("id").union(df.select("id")), df, common.Scratch(spark)).collect()
    for r in maps:
        bits = {h % (64 * line_dedup.MAP_WORDS) for h in got[r["id"]]}
        assert (r["n"], r["lost"]) == (len(set(got[r["id"]])), len(set(got[r["id"]])) - len(bits))
        assert bits == {64 * w + b for w in range(line_dedup.MAP_WORDS) for b in range(64) if r[f"m{w}"] >> b & 1}
    assert len(maps) == len(lines)


def test_line_dedup_compares_rays_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 8)
    groups = spark.createDataFrame([(1, k, k % 3 > 0) for k in range(90)], "band long, id long, out boolean")
    left, right = line_dedup._dealt(groups, "band")
    assert max(x["count"] for side in (left, right) for x in side.groupBy("band", "i", "j").count().collect()) < 8 * 4
    met = left.alias("x").join(right.alias("y"), ["band", "i", "j"]).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()
    assert sorted((r["a"], r["b"]) for r in met) == [(a, b) for a in range(90) if a % 3 for b in range(90)]

    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # Many lines are half like the first, and like each other in pairs only.
    hub, lines, stays = make(300), [], []
    for k in range(60):
        line = hub[:190] + make(110)
        lines += [line, line[:-5] + make(5)]
        stays += [True, False]
    assert kept_lines(spark, [hub, *lines]) == [True, *stays]


def test_saved_tables_need_no_marker(spark):
    path = common.Scratch(spark).save(spark.range(3)).scratch_path  # before: a process of the driver for the file _SUCCESS of each table
    names = [f.getPath().getName() for f in _listed(spark, path)]
    assert names and not [n for n in names if n.startswith("_")]


def _listed(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)


def test_lines_are_dealt_by_band_once(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(40) * 16 + b for b in range(16)]) for i in range(60)]
    known = common.Scratch(spark).save(spark.createDataFrame(rows, "id long, keys array<long>"))
    shared = line_dedup._shared(known)
    got = shared.collect()
    members = {}
    for i, keys in rows:
        for key in keys:
            members.setdefault(key, []).append(i)
    assert sorted((r["band"] or 0, r["hub"], r["id"]) for r in got) == sorted((k * (len(v) > 2), min(v), i) for k, v in members.items() for i in v if i != min(v))
    plan = shared._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    dealt = [x for x in plan if "Exchange hashpartitioning" in x]  # a line of its own each; what is reused is named in its line
    assert ["ReusedExchange" in x for x in dealt] in ([False, True], [True, False])  # before: hubs by themselves, from a saved table


def test_maps_are_made_once(spark, monkeypatch):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hub, lines, stays, made, maps = make(300), [], [], [], line_dedup._maps
    for k in range(40):
        line = hub[:190] + make(110)
        lines += [line, line[:-5] + make(5)]
        stays += [True, False]
    monkeypatch.setattr(line_dedup, "_maps", lambda *args: (made.append(1), maps(*args))[1])
    assert kept_lines(spark, [hub, *lines]) == [True, *stays]
    assert made == [1]  # before: with each round of comparisons
