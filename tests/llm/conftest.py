from __future__ import annotations

import random

import pytest

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, copy int, stratum string, label int, rate double, rep long, comp long, digest string, row int, k int, n int, u double, size int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank, one-word and very long texts, copies, repeated rows, a hot source, ties."""
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "water", "soil", "über", "Straße", "no.", "x@y.org"]
    long = " ".join(r.choice(words) + str(r.randrange(3000)) for _ in range(40_000))
    base = " ".join(r.choice(words) for _ in range(120))
    texts = [None, "", " ", "\n\t", "one", "One", "two words", "Two  words", "a\x0bb", long, long + " more", base, base, base + " end", base.replace("alpha", "ALPHA"), " " + base, "1" * 500, "!" * 300, "日本語 の 文", "a b", "x" * 20_000]
    rows = [(i, t, "en", None if i % 7 == 3 else "hot" if i % 2 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[11], (None, "nobody's text", None, None, None), (None, None, None, None, None)]
    return [(*x, 0.5, 3, 2, "s", 1, 1.5, 8, 9, "d", 1, 2, 3, 0.25, 4) for x in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names the operators use themselves."""
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
