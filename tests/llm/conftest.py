import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, key string, n long, size long, part long, epoch int, text_hash long, uid long, cid long, class_id long, h long, at long, word string, fold long"
CLASH = (0.5, 7, "k", 1, 2, 3, 4, 5, 6, 8, 9, 1, 2, "w", 3)


def rows_to_docs(spark, rows):
    """Documents with columns named like those that operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), *CLASH) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, repeated rows and repeated ids."""
    rng = random.Random(3)
    long = words(rng, 60_000, 9_000)
    base = [(i, words(rng, rng.randrange(30, 200)), f"s{i % 3}") for i in range(40)]
    return [
        *base, (100, None, "s0"), (101, "", "s1"), (102, " \n\t ", None), (103, long, "s2"), (None, "no id here", "s0"), (None, None, None), base[3], base[3],
        (104, base[5][1], "s1"), (105, "one", "s0"), (106, "ab", "s0"), (107, "Ünïcode — ☃ \U0001f600 texts, ok.", "s0"), (7, "another text of id seven", "s2"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return rows_to_docs(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return rows_to_docs(spark, [])
