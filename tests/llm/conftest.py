import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, row long, mix string, `__key` string, score double"


def filled(*rows):
    return [(*r, *[None] * (11 - len(r))) for r in rows]


WORDS = "the quick brown fox jumps over the lazy dog while seven wizards boil quartz under pale moons and nobody asks why it must be so".split()


def prose(n, step=1):
    return " ".join(WORDS[(i * i * step + 3 * i) % len(WORDS)] + str((i * 7 * step) % 23) for i in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    rows = filled(
        (1, prose(60), "en", "a", 1, True, "x", 5, "m", "k", 0.5),
        (2, prose(60), "en", "a"),
        (3, prose(60).upper(), "de", "b"),
        (4, prose(60).replace(" ", "  "), None, None),
        (5, None, "en", "a"),
        (6, "", "fr", "b"),
        (7, " \t\n ", None, "c"),
        (8, prose(5000, 3), "en", "a"),
        (None, prose(60), "en", "a"),
        (None, "only me é 日本語 ▁", None, None),
        (9, "idiot", "en", "b"),
        (10, "four words in here", "en", "b"),
        (10, "four words in here", "en", "b"),
        (11, "x" * 3000, "en", "b"),
        (12, prose(60) + " more", "en", "b"),
    )
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
