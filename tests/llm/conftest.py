import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns with names that operators use inside.
CLASHES = ["id", "row", "sig", "hash", "salt", "block", "extra", "out", "mark", "doc", "component", "kept", "n", "x", "judged"]


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def hard_texts():
    """(doc_id, text): nulls, empty and long texts, copies exact and near, shared passages, ties, repeated rows."""
    rng = random.Random(5)
    long, passage = words(rng, 3000), words(rng, 60)
    near = [words(rng, 120, 10_000)]
    for _ in range(25):
        w = rng.choice(near).split()
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        near.append(" ".join(w))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b"), (5, "A  b"), (6, "a b"), (7, "é ü ß"), (8, "\x1f x 　 y\x85z"), (9, long), (10, long + " tail"), (11, "ab " * 400), (12, "<|endoftext|> </s> it's 12"), (13, words(rng, 10) + " " + passage), (14, passage + " " + words(rng, 12)), (15, words(rng, 40) + "\n" + passage + "\n" + words(rng, 5)), (16, "one two three four five"), (17, "one two three four five"), (18, "five four three two one zero")]
    rows += [(100 + k, t) for k, t in enumerate(near)]
    rows += [(200 + k, words(rng, rng.randrange(1, 80))) for k in range(40)]
    return [*rows, (300, "same row twice here"), (300, "same row twice here")]


@pytest.fixture(scope="session")
def hard(spark, hard_texts):
    """These as a table, with clashing columns and a null identifier."""
    from pyspark.sql import functions as F

    rows = [(i, t, "xx" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t or "")) for i, t in [*hard_texts, (None, "no identifier at all")]]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
