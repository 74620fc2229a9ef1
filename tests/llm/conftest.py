import random

import pytest

LATIN = "the of and that with from river stone house garden morning letter number water night paper window green silver mountain".split()


@pytest.fixture(scope="session")
def make_text():
    def make(rng: random.Random, n: int) -> str:
        return " ".join(rng.choice(LATIN) + rng.choice(["", "s", "ly", "ing", "er", "ness"]) + rng.choice(["", str(rng.randrange(40))]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30000))
    rows = [
        (1, "a plain short text about rivers", "en", 5),
        (2, None, None, None),
        (3, "", "en", 0),
        (None, "a row without an id but with words", None, 1),
        (4, long_text, "en", 1),
        (5, "   \n\t ", "de", 1),
        (6, "a plain short text about rivers", "en", 5),
        (6, "a plain short text about rivers", "en", 5),
        (7, "é́ ΑΣ <|endoftext|> <|startoftext|>  x\x1cy \U0001f600 'S it's", "fr", 2),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long").selectExpr(
        "*", "'x' AS digest", "1 AS node", "2 AS label", "3 AS key", "'r' AS removed", "0 AS score", "'t' AS text_", "1 AS id", "1 AS t"
    )
