import random

import pytest
from pyspark.sql import types as T

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, label long, h long, i long, "
          "t string, n int, a int, b int, size int, score double, target double, taken long, k int, "
          "__lang string, round int")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (id, text[, lang, source]), with many extra columns whose names operators use."""
    def make(rows):
        full = []
        for r in rows:
            r = (*r, *(None,) * (4 - len(r)))
            full.append((r[0], r[1], r[2], r[3], None, 1, 2, 3, "x", 4, 5, 6, 7, .5, .25, 8, 9, "y", 10))
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Null and empty texts, blanks, repeats of text and of whole rows, a null id, a long text."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, "one two", "en", "s"),
            (5, "one two", "fr", None), (5, "one two", "fr", None), (None, "One  TWO", "en", "z"),
            (7, long, "en", "s"), (8, long, None, "u"), (9, "1 2 3 !!", "en", "u"), (10, "\0\0 é", "en", "")]
    return frame(rows)


@pytest.fixture(scope="session")
def nothing(frame, spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
