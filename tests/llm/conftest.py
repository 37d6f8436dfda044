import pytest

#: doc_id, text, lang, source, n_chars: nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "a b c d e f g", "en", "s1", 13),
    (1, "a b c d e f g", "en", "s1", 13),
    (2, None, None, None, None),
    (3, "", "en", "s0", 0),
    (None, "a b c d e f g", "en", None, 13),
    (4, " \t\n\r\x0b\x0c ", "de", "s0", 7),
    (5, "Über Ärger Σας <|endoftext|> don't 'S İstanbul  x y 12 ½", "de", "s2", 50),
    (6, "word " * 9000, "en", "s0", 45000),
    (7, "The same passage of words as its twin has it", "fr", "s1", 40),
    (8, "THE SAME PASSAGE OF WORDS AS ITS TWIN HAS IT", "fr", "s1", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns whose names clash with those that the operators use."""
    from pyspark.sql import functions as F

    names = "size shard slot place salt arc rank n base h skey target copies length piece start score predicted block label features toxic quality word rep fp".split()
    return odd.select("*", *[F.lit("x").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
