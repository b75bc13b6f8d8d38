import random

import pytest

WORDS = [f"{a}{b}" for a in "ka lo mi ne pu ra sto tri vex zu".split() for b in "an ber cor dil et fo gus".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([2, 5, 20, 60, 150]))) for i in range(n)]
    base, passage = prose(rng, 150), prose(rng, 90)
    for i in range(12):
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((n + i, " ".join(words)))
    for i in range(8):
        rows.append((n + 20 + i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}"))
    rows += [(n + 40 + i, rows[5][1]) for i in range(5)]
    rows += [(n + 50, None), (n + 51, ""), (n + 52, " \t\n"), (n + 53, "one"), (n + 54, "Two words"), (n + 55, "two WORDS"), (n + 56, "é" * 900), (n + 57, "ab" * 700), (n + 58, prose(rng, 4000))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = [(i, t, "x", 1, "clash") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, n long, key string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
