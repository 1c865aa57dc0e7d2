import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, part string, score string, kept string, _id long, _n long, media string, h string, embedded string"
LONG = "Lorem ipsum dolor sit amet consectetur " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and extra columns with clashing names."""
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from the bear in the wood over there today again"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from the bear in the wood over there today again"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from the bear in the wood over there today again"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, LONG),
        (None, "a row without an id"),
        (None, None),
        (7, "Ünïcödé ▁▁ 漢字 \U0001f600 <s> </s> <0x41> é́"),
        (8, "one two"),
        (9, "x\x00y\x1cz"),
        (10, "A" * 5000 + " " * 3000 + "\n" * 300),
    ]
    return spark.createDataFrame([(i, t, None, None, None) + ("x",) * 5 + (1, 2) + ("x",) * 3 for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
