import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, doc string, copies int, shard string, _id int, found int"


def frame(spark, rows):
    """Documents from (doc_id, text, source) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", 7, "z", 1, None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def documents():
    return frame


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def long_text(words=30_000, seed=1):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(words))
