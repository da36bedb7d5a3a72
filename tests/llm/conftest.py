import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "an er th ou le re ti on de is ba ku".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def hard_texts():
    """Copies, near copies, shared passages, repeats, nulls, empty and long texts."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(12)]
    passage, edge = prose(rng, 60), prose(rng, 35)
    near = []
    for t in base[:6]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    shared = [f"{prose(rng, 30)}\n{passage} {prose(rng, 10)}" for _ in range(4)] + [f"{prose(rng, 20)} {edge}", f"{edge} {prose(rng, 20)}"]
    inside = [f"{passage} middle {passage}", "The " * 90, " ".join(["a b c"] * 40)]
    odd = [None, "", "   \n\t", "one", "one", "two words", prose(rng, 34), prose(rng, 6000), "é 😀 " * 20, "x" * 5000]
    return base + base[:3] + near + shared + inside + odd


@pytest.fixture(scope="session")
def docs(spark, hard_texts):
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(hard_texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns that have the names of outputs and internals."""
    from pyspark.sql import functions as F

    return docs.select("*", F.lit(1).alias("key"), F.lit(2).alias("ids"), F.lit(3).alias("row"), F.lit("x").alias("kept"), F.lit(5).alias("TEXT"), F.lit(6).alias("score"), F.lit(7).alias("h"))


@pytest.fixture(scope="session")
def unnamed(spark, hard_texts):
    """Keys null and repeated."""
    return spark.createDataFrame([(None if i % 2 else 7, t, None, None, None) for i, t in enumerate(hard_texts)], SCHEMA)
