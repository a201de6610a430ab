"""Byte-level BPE against the library itself, with chunks so small that texts are stitched many times."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ephemera.llm import bpe

OWN = bpe.tokenizer(bpe.VOCABULARY)
ODD = [" ", "  ", "\n", "\t ", "\r\n", "'", "'s", "'re", "'ll", "a", "bc", "Z", "é", "ß", "日本", "١٢", "7", "42", "!", "--", "😀", "́", "\U0001e800", "Ᲊ", "　", "\x1c", "\x85", "﻿", "<|endoftext|>", "ſ", "İ", "\U00010940"]


def want(text):
    ids = np.array(OWN.library.encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, sha256(ids).hexdigest(), sha256((text or "").encode()).hexdigest()


def texts(seed, count, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(0, most))) for _ in range(count)]


def test_splitter_cuts_as_the_library():
    for text in texts(1, 300, 60):
        pieces = OWN.split(text)
        assert "".join(pieces) == text
        ids = OWN.encode(pieces)
        assert np.frombuffer(ids, "<u4").tolist() == OWN.library.encode_ordinary(text) and OWN.decode(ids) == text.encode()


def test_classes_are_the_library_s():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    # Each character with a letter, a digit and a mark behind it: where it is cut tells its class.
    for after in "a!":
        text = "\n".join(c + after for c in every)
        assert np.frombuffer(OWN.encode(OWN.split(text)), "<u4").tolist() == OWN.library.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(5))
def test_certain_starts_are_those_of_the_whole_text(seed):
    for text in texts(seed, 60, 60):
        whole = bpe.cut(OWN.split, text, True)[0]
        for end in range(1, len(text)):
            starts, sure = bpe.cut(OWN.split, text[:end], False)
            assert set(starts[:sure]) <= set(whole) or end == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(5, 3), (16, 8), (40, 20), (1, 1)])
def test_chunks_are_stitched(spark, chunk, overlap):
    rows = [*enumerate(texts(7, 40, 50)), (100, None), (101, ""), (102, "a" * 200 + " b"), (103, " " * 150 + "x"), (104, "it's " * 30), (105, "word " * 40), (105, "word " * 40), (None, "no id " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({n: F.lit("x") for n in ("id", "row", "k", "ends", "head", "tail", "sync", "until", "chunks", "starts", "n_tokens", "ids")})
    got = bpe.encode(docs, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *want(t)) for i, t in rows), key=str)


def test_long_texts_and_runs(spark):
    """Runs that are longer than any overlap, and than the library's own engine can take."""
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(120_000))
    rows = [(1, prose), (2, "x" * 300_000 + " end"), (3, prose[:70_000] + " " * 150_000 + prose[:70_000])]
    spaces = 1_200_000
    docs = spark.createDataFrame([*rows, (4, " " * spaces + "y")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode(docs).collect()}
    assert {i: got[i] for i in (1, 2)} == {i: want(t) for i, t in rows[:2]}
    run = lambda text: OWN.encode(OWN.split(text))
    for i, text in ((3, rows[2][1]), (4, " " * spaces + "y")):
        assert got[i] == (len(run(text)) // 4, sha256(run(text)).hexdigest(), sha256(text.encode()).hexdigest())
    assert public_tokenizers.PATTERN


def test_encoding_of_nothing(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, bpe.op12_byte_bpe(spark, sf_dir).collect()))
    assert got == sorted((r["doc_id"], *want(r["text"])) for r in docs)
