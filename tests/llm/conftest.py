import random

import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, at string, bucket int, digest string"


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; the last
    four columns have names that the operators use themselves."""
    rng = random.Random(7)
    words = ["alpha", "bravo", "delta", "golf", "hôtel", "india", "the", "of", "und"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(6000))
    base = [
        (1, "The quick brown fox jumps over the lazy dog. " * 4, "en", "a"),
        (2, "The quick  brown fox jumps over the lazy dog. " * 4, "en", "a"),
        (2, "The quick  brown fox jumps over the lazy dog. " * 4, "en", "a"),
        (3, "", "en", "b"), (4, None, "en", "b"), (5, " \t\n\x0b\x0c\r", None, None),
        (None, "the cat and the dog are in the house of the man", "en", "b"),
        (None, "the cat and the dog are in the house of the man", "en", "b"),
        (6, "der Hund und die Katze sind in dem Haus von dem Mann", "de", None),
        (7, long_text, "en", "c"), (8, long_text[:20000] + " changed " + long_text[20000:], "en", "c"),
        (9, "12345 67890 !!!", "en", "a"), (10, "x", None, "a"), (11, "é　 é \U0001f600 <|endoftext|> </s>", "fr", "a"),
    ]
    return [(i, t, la, s, len(t) if t else None, 1, "here", 2, "d") for i, t, la, s in base]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
