"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

EXTRA = "id long, size long, chunk int, score double, n long, spans string, rank int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
WORDS = "the and attion erthe onhaly thing und der nicht schach keit para que mente les des eaux oui".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "a b c d"), (6, base), (7, " ".join(near)), (8, base.upper()), (8, base.upper()),
        (9, prose(2, 6000)), (10, "123 456 !!!"), (11, 'token = "908038b7daaf91e730d2f64001c52934d43d0000" mail jo.81@mail5.example.com 1.43.173.185'),
        (None, "no id here"), (12, "two  spaces ▁ and\ttab\n newline 😀 中文"), (13, "a@b.c@d.e +1 (377) 555-0271 4953 9352 5300 2528"), (14, base), (15, prose(3, 1)), (16, "a <|endoftext|> b <|endoftext|>"),
    ]
    return [(i, t, "en" if (i or 0) % 2 else "de", "src0", len(t or ""), 1, 2, 3, 0.5, 4, "x", 5) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
