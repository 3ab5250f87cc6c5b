import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make_docs(seed=4, n=120):
    """Invented prose with copies, near copies, shared lines, nulls, empties and personal data."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    shared, texts = [line(9) for _ in range(4)], []
    for i in range(n):
        kind = i % 8
        if kind == 1 and texts:
            t = rng.choice(texts)
        elif kind == 2 and texts:
            w = (rng.choice(texts) or "x").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = "\n".join([line(12), rng.choice(shared).upper() + "  ", line(30), rng.choice(shared)])
        elif kind == 4:
            t = f"Call +1 (555) 010-{rng.randrange(1000, 9999)} or a{i}@mail.example.org. {line(20)}\n{line(40)}"
        elif kind == 5:
            t = [None, "", "  \n\t", "one two", "é中 ñ " * 40][(i // 8) % 5]
        else:
            t = "\n".join(line(rng.randrange(8, 60)) for _ in range(rng.randrange(1, 6)))
        texts.append(t)
    texts += [texts[0]] * 20 + [" ".join([line(3000)] * 3)]
    return [(i, t, "en", [None, "a", "b", "é"][i % 7 % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("x") for c in ("at", "size", "n", "score", "shard", "slot", "ids", "n_tokens", "kept", "h1", "words", "rank", "th", "t", "k")})


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(not (r[1] or "").isupper() and r[0] % 8 != 5), 0) for r in rows if r[0] % 3], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
