import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text) with copies, near copies, ties, repeated rows, empty, null, short and long texts."""
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, base = [], [make(rng.randint(30, 200)) for _ in range(60)]
    rows += list(enumerate(base))
    for k, text in enumerate(base[:40]):
        split = text.split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(split))
            split[at] = rng.choice(words)
        rows.append((100 + k, " ".join(split)))
    rows += [(200 + k, base[k % 5]) for k in range(12)]
    rows += [(300, base[0].replace(" ", "\n\t")), (301, base[0].upper()), (302, ""), (303, None), (304, " \n "), (305, "one"), (306, "ONE"), (307, "one two"), (308, make(9000)), (309, "one"), (309, "one"), (310, base[1] + "\n" + base[2] + "\n" + base[1]), (311, "Grüße 😀 " + base[3])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    lang, source = F.when(F.col("doc_id") % 5 == 0, None).otherwise("en"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))
    # Extra columns whose names clash with those that operators use inside.
    return rows.withColumns({"lang": lang, "source": source, "n_chars": F.length("text").cast("long"), "key": F.lit("x"), "id": F.lit(1), "n": F.lit(None).cast("int")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
