import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")

#: Texts that every operator must take: null, empty, white space, signs, one word, ties, copies, a very long one.
LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = [None, "", "  \n\t ", "!!! ???", "word", "one two three four five six seven", "one two three four five six seven", "naïve café 中文 😀", "a" * 5000, LONG]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd texts, with columns whose names clash with those that operators use inside."""
    rows = [(k, t, "en" if k % 2 else None, "s", 0, 1.5, "x", 7) for k, t in enumerate(TEXTS)]
    rows += [(None, "one two three four five six seven", "fr", "s", 0, 1.5, "x", 7), (5, "one two three four five six seven", "en", "s", 0, 1.5, "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, id string, set int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
