import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, fp string, size string, base_spans string, key string, node string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and clashing extra columns."""
    extra = ("x",) * 7

    def rows():
        yield (1, "plain words of a text", "en", "b", 21, *extra)
        yield (1, "plain words of a text", "en", "b", 21, *extra)
        yield (2, "", "en", "a", 0, *extra)
        yield (3, None, None, None, None, *((None,) * 7))
        yield (None, "call +1 (938) 555-0822 or mail a@b.cd", None, "a", 37, *extra)
        yield (5, "\t\n ", "en", None, 3, *extra)
        yield (6, "long " * 40_000, "en", "b", 200_000, *extra)
        yield (7, "é" * 50_000 + " 🙂 4111 1111 1111 1111", "fr", "c", 50_022, *extra)

    return spark.createDataFrame(list(rows()), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (6, 0, 0)], "doc_id long, quality int, toxic int")


