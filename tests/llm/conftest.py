import random
import re

import pytest

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def fold_case(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORDS.findall(fold_case(text or ""))


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, and extra columns whose names clash with our own."""
    rng = random.Random(5)
    one, two = prose(rng, 40), "Ein Satz, der etwas länger ist. Und noch einer.\nEin Satz, der etwas länger ist. Und noch einer!"
    rows = [
        (1, one, "en", "web", 5), (2, one, "en", "web", 5), (2, one, "en", "web", 5), (3, None, "de", "web", None), (4, "", None, None, 0), (None, two, "de", "books", 9), (None, None, None, None, None),
        (5, " \n\t\n", "en", "web", 3), (6, prose(rng, 60_000), "en", None, 1), (7, two, None, "books", 1), (8, "1234 5678\n!!!", "fr", "web", 2), (9, one + " tail", "en", "web", 7), (10, two, "de", "books", 9), (11, "\x00 ñ 😀 a", "es", "web", 2),
    ]
    extra = "key string, score int, hash string, n_lines int, lang_pred string, topic string, row int, __id int, __text string"
    return spark.createDataFrame([(*r, f"k{i}", i, None, i, "x", "y", i, i, "z") for i, r in enumerate(rows)], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


@pytest.fixture(scope="session")
def plain_documents(odd_documents):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    return odd_documents.toDF(*names, *(f"x{k}" for k in range(9))).select(*names)


@pytest.fixture(scope="session")
def empty_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
