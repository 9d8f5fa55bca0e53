"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        full = [(i, t, "en", s[0] if s else "a", None) for i, t, *s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Rows that any operator must take."""
    r = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    long = " ".join(r.choice(words) for _ in range(20_000))
    rows = [(0, "", "a"), (1, None, "a"), (2, " \n\t ", None), (3, long, "b"), (3, long, "b"), (None, "one two three four five six", "b"), (None, None, None), (7, "x", "c"), (8, "Übung ñandú 中文字  wide 🙂", "c"), (9, "a" * 3000, "c"), (-5, "one two three four five six", "b"), (11, "line\n" * 50, "a")]
    return docs(rows)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def sorted_rows():
    return table
