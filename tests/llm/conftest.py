import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "".join(f"word{i % 977} and the other thing number {i} of them all.\n" for i in range(4000))
CLEAN = "The cat sat on the mat and it was as good for the dog as that is to be in the house by the sea with all of this and more from them. "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [
        (1, CLEAN * 3, "en", "a", 9), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, LONG, "en", "b", 5), (5, CLEAN * 3, "en", None, 9), (6, "  \n\t ", "en", None, 5),
        (7, CLEAN * 3, "en", "a", 9), (7, CLEAN * 3, "en", "a", 9), (None, "lost words without an id", None, None, None), (8, "x" * 70_000, "en", "a", 1), (9, "é中\U0001f600 İ", "de", "c", 4),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use themselves."""
    names = ["_row", "_class", "_key", "key", "words", "size", "spans", "row_key", "copy", "node", "label", "gap", "range", "end", "h", "k", "lang_pred", "score", "n_words", "kept", "upper"]
    return odd.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
