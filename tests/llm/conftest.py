"""Documents with every oddity that an operator has to take."""

from __future__ import annotations

import random

import pytest

#: Names that operators use inside; as extra columns they must not disturb.
CLASHES = "score double, digest string, kept boolean, key string, size bigint, block int, bucket int, items string, node bigint, band bigint, body string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    long_ = prose(1, 30_000)
    passage = prose(2, 60)
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "one"), (6, long_), (7, long_[:-6] + " other"),
        (8, f"{prose(3, 40)} {passage} {prose(4, 40)}"), (9, f"{prose(5, 30)} {passage} {prose(6, 70)}"),
        (10, passage), (11, passage), (11, passage), (12, "Ünïcödé – текст 文本 " * 30), (13, "x" * 5000),
        (14, "a b " * 400), (15, "<|endoftext|> is text here"), (16, "under the MIT license"), (None, "no id"), (None, "no id"), (None, None),
    ]
    out += [(100 + i, prose(7, 200)) for i in range(25)]
    out += [(200 + i, prose(50 + i, 120)) for i in range(30)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else f"s{n % 3}", None, 0.5, "d", True, "k", 3, 1, 2, "i", 9, 8, "b") for n, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(100, 130)] + [(None, 1, 0), (200, None, 0), (201, 1, None), (201, 0, 1), (999_999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
