import random

import pytest

#: Columns whose names operators use inside, to see that they don't clash.
CLASHING = {"fingerprint": 1, "norm": "x", "_salt": 3, "cell": 4, "u": 0.5, "k": 6, "id": 7, "starts": 8, "tokens": 9, "letters": True, "held_out": "no", "bands": 1}


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source): copies, near copies, shared passages, white space, empties, nulls, repeated rows, a long text."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = words(rng, 30, vocabulary)
    rows = []
    for k in range(60):
        rows.append((k, words(rng, rng.randint(1, 120), vocabulary), rng.choice(["aa", "bb"]), f"s{k % 3}"))
    base = words(rng, 200, vocabulary)
    for k in range(60, 75):
        own = base.split()
        own[rng.randrange(200)] = f"new{k}"
        rows.append((k, " ".join(own), "aa", "s0"))
    for k in range(75, 90):
        rows.append((k, f"{words(rng, 10, vocabulary)} {passage} {words(rng, 10, vocabulary)}", "bb", "s1"))
    for k in range(90, 100):
        rows.append((k, base.replace(" ", "  \n", 1) if k % 2 else base, "aa", "s0"))
    rows += [(100, "", "aa", "s0"), (101, None, None, None), (102, " \t\n", "bb", None), (103, "", None, "s2"), (104, "Hé ß x y", "aa", "s2"), (105, "1 2 3 !!", "bb", "s1")]
    rows += [(106, words(rng, 30_000, vocabulary), "bb", "s0"), (107, f"{passage} {passage}", "aa", "s1"), (3, rows[3][1], rows[3][2], rows[3][3]), (None, "no id here", "aa", "s0"), (None, base, "aa", "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(a, b, c, d, None if b is None else len(b)) for a, b, c, d in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
