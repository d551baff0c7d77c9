import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank double, kept string, row string"
PROSE = "the river and the old stone bridge were quiet that evening while people walked home to their small houses on the hill"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns whose names operators use too."""
    words = PROSE.split()
    long_text = " ".join(f"{words[k % len(words)]}{k}" for k in range(30_000))
    copy = " ".join(w if k % 3 == 0 else f"{w}{k}" for k, w in enumerate(words * 4))
    rows = [
        (1, copy, "en", "a"), (2, copy, "en", "a"), (3, copy + " more", None, None), (4, None, "en", "a"), (5, "", "en", "b"), (6, " \n\t ", "de", None),
        (7, long_text, "en", "b"), (8, "Ein kurzer Satz.", "de", "c"), (8, "Ein kurzer Satz.", "de", "c"), (None, PROSE, "en", "a"), (None, None, None, None),
        (10, "x", "en", "c"), (11, PROSE + ".\n" + PROSE, "en", "c"),
    ]
    return spark.createDataFrame([(*r, 0, 9, 0.5, "yes", "r") for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
