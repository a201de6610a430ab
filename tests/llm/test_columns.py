"""Columns of a caller that are called like those that operators use inside, and tables that operators leave behind."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ephemera.llm import bpe, chat_format, common, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, quality, secret_scan, toxicity

#: Every name that the subpackage's code gives to a column for a while.
NAMES = sorted({name for path in Path(common.__file__).parent.glob("*.py") for name in re.findall(r"[\"'](_?[a-z][a-z0-9_]{0,15})[\"']", path.read_text())} - {"doc_id", "text", "source", "lang"})

KEEPING = {
    "quality": (lambda df: quality.score(df, quality.DocumentModel()), {"doc_score", "host_posterior", "path_posterior", "score"}),
    "mixing": (lambda df: mixing.mix(df, mixing.Target(repeats=1)), {"mix_epoch", "mix_block", "mix_at", "mix_tokens"}),
    "sketch": (lambda df: fingerprints.with_sketch(df, "text", "sketch"), {"sketch"}),
    "next": (lambda df: fingerprints.with_next(df, "doc_id", ["text"], "text"), {"next_text"}),
    "lines": (lambda df: line_dedup.dedup_lines(df), {"n_lines", "n_dropped"}),
}
IGNORING = {
    "exact": lambda df: exact_dedup.exact_dedup(df),
    "secrets": lambda df: secret_scan.findings(df, secret_scan.scan_new(df)),
    "toxicity": lambda df: toxicity.toxicity(df, toxicity.Lexicon({" so": 1.0})),
    "near": lambda df: near_dedup.near_components(df),
    "packing": lambda df: packing.pack(df),
    "chats": lambda df: chat_format.format_chats(chat_format.canonical_turns(df.drop("conv_id").withColumnRenamed("doc_id", "conv_id").withColumns({"role": F.lit("user"), "turn": F.lit(1)}))),
    "bpe": lambda df: bpe.encode(df, chunk=4, overlap=2),
}


@pytest.fixture(scope="module")
def crowded(spark):
    """Three documents, with a column of every name."""
    rows = spark.createDataFrame([(1, "some text\nof two lines", "s", "en"), (2, None, None, None), (3, "other words, so many", "s", "de")], "doc_id long, text string, source string, lang string")
    return rows.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_other_columns_keep_their_values(crowded, name):
    operate, own = KEEPING[name]
    got = operate(crowded)
    assert len(set(got.columns)) == len(got.columns) and set(got.columns) == {*crowded.columns, *own}
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    for r in rows:
        assert all(r[n] == f"{n}{r['doc_id']}" for n in NAMES if n not in own)


@pytest.mark.parametrize("name", sorted(IGNORING))
def test_other_columns_do_no_harm(crowded, name):
    plain = crowded.select("doc_id", "text", "source", "lang")
    assert sorted(map(str, IGNORING[name](crowded).collect())) == sorted(map(str, IGNORING[name](plain).collect()))


def test_dead_tables_are_deleted(spark, docs, monkeypatch):
    made = []
    init = common.Scratch.__init__
    monkeypatch.setattr(common.Scratch, "__init__", lambda self, s: (init(self, s), made.append(self))[0])
    for operate, left in ((near_dedup.near_components, 3), (line_dedup.dedup_lines, 1)):
        made.clear()
        operate(docs)
        kept = [p for s in made for p in Path(re.sub("^file:/*", "/", s.root)).iterdir()]
        assert len(kept) <= left


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint"):
        common.Scratch(Session)
