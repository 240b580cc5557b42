import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, k1 int, score double, h string, label int, root string"


def rows_of(texts, start=0):
    return [(start + i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t), "x", 7, 0.5, "h", 1, "r") for i, t in enumerate(texts)]


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, marks only, one word, ties, copies, very long, one very long word, other scripts."""
    rng = random.Random(5)
    long = prose(rng, 20000, 3000)
    base = prose(rng, 60)
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    return [None, "", " \n\t ", "***", "***", "one", "a b c", "A B, c!", base, base, base.upper(), near, long, "y" * 50000, "蚌埠住了 笑死 我了 绷不住 了 好", "é" * 30 + " ü", "a\x00b c d e f g", base + "\n" + base]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    rows = rows_of(odd_texts)
    rows += [rows[8], (None, odd_texts[8], *rows[8][2:]), (None, None, *rows[0][2:])]  # a repeated row, and rows without ids
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(8, 1, 0), (9, 0, 1), (12, None, None), (99, 1, 1), (None, 1, 1), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
