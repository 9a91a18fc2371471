import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators would like for themselves.
CLASH = "size long, n_lines string, n_dropped string, lang_pred int, score string, ambiguous string, spans long, copies string, taken string, target string, kept string, _text string, _q string, s string, held_out int"


def words(rng, n, low=400):
    return " ".join(f"w{rng.randrange(low)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, exact and near copies, ties, repeated rows, a hot source."""
    rng = random.Random(1)
    base = words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    long = words(rng, 30_000, 100_000)
    shared = "This line is shared by several documents of the set"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 5), (4, base, "en", "a", 1), (5, base, "en", "b", 1), (6, " ".join(near), "en", "a", 1), (7, "one two", "de", None, 7),
        (8, "ONE two", "de", "é", 7), (9, long, "fr", "a", 1), (10, f"{shared}\nown line of ten here\n{shared}", "en", "a", 1), (11, f"  {shared.upper()}\t\nmore", None, "a", 1),
        (12, f"x\n{shared}", "en", "b", 1), (13, "12 34 ** !!", "en", "a", 1), (None, "a text without an id of its own", "en", "a", 1), (None, None, "en", "a", 1), (14, base, "en", "a", 1), (14, base, "en", "a", 1),
    ]
    rows += [(20 + i, words(rng, rng.randrange(1, 60)), "en" if i % 3 else "fr", "a" if i % 2 else f"s{i % 5}", i) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clash(edge):
    from pyspark.sql import functions as F

    return edge.select("*", *(F.lit("7").cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
