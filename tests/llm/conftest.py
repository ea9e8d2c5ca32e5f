import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, tiny and long texts, repeated rows, ties, and columns with names that operators use."""
    base = prose(120, 1)
    rows = [
        (0, base, "en", "b", 5, 0.5, "x"),
        (1, base, "en", "b", 5, 0.5, "x"),
        (2, base.replace("alpha", "omega", 1), "en", None, None, None, None),
        (3, None, None, "a", None, 0.1, "y"),
        (4, "", "en", "a", 0, 0.1, "y"),
        (5, "word", "en", "a", 4, 0.1, "y"),
        (5, "word", "en", "a", 4, 0.1, "y"),
        (None, base, "en", "a", 4, 0.1, "y"),
        (None, "quite another text without an id, and long enough to have shingles", "en", "a", 4, 0.1, "y"),
        (7, prose(30_000, 2), "en", "c", 4, 0.1, "y"),
        (8, "mail me@example.com\n\n  ÄÖ ß 東京   \x00 end", "en", "c", 4, 0.1, "y"),
        (9, prose(80, 3) + "\n" + prose(60, 1), "en", "é", 4, 0.1, "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string").cache()
