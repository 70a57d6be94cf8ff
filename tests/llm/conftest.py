import re

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that the operators use themselves
    "score double, predicted int, held_out boolean, n_words bigint, n_lines bigint, key bigint, _key bigint, fp bigint, label int, ids string, n_tokens bigint"
)
CLASH = (0.5, 1, True, 1, 1, 7, 7, 7, 1, "x", 1)


def rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977} the" for i in range(60_000))
    texts = [
        (1, "the cat sat on the mat with the other cat of the house\nand a second line of the text", "en", "a"),
        (2, "le chat est sur la table avec les autres chats de la maison", "fr", "a"),
        (3, "", "en", "b"), (4, None, "en", "b"), (5, " \n\t ", "fr", None), (6, "!!! 123 ...", None, "a"),
        (7, "the cat sat on the mat with the other cat of the house\nand a second line of the text", "en", "a"),
        (7, "the cat sat on the mat with the other cat of the house\nand a second line of the text", "en", "a"),
        (8, long, "en", "b"), (9, "x" * 30_000, "en", "b"), (None, "a text without an id", "en", "a"), (10, "Ünïcode 日本語 текст ελληνικά", None, "c"),
        (11, "one", "en", "c"), (12, "one two", "en", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    """Rows of which every column is null."""
    return spark.createDataFrame([(None,) * 16] * 3, SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
