import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside, to show that extra ones do no harm.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, id long, a long, b long, n long, region long, words int, key string, piece int, length long, start long, part int, depth int, bucket long, hash long, window long, component long"


def prose(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(4)


@pytest.fixture
def table(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(8)
    long_text = prose(rng, 30_000)
    rows = [
        (1, None, "en", "s", 1), (None, "no id here at all", "en", None, None), (2, "", None, None, None), (3, " \n\t ", "en", "s", 3),
        (4, long_text, "en", "s", None), (5, "red green blue cyan plum teal", "en", "s", 2), (5, "red green blue cyan plum teal", "en", "s", 2),
        (6, "red green blue cyan plum teal", None, "s", 2), (7, "12 34 5678", "en", "s", 2), (8, "é中😀 \x00 text", "fr", "s", 9),
    ]
    extra = (0.5, "x", 1, 2, 3, 4, 5, 6, "k", 7, 8, 9, 1, 2, 3, 4, 5, 6)
    return spark.createDataFrame([r + extra for r in rows], CLASHING)
