import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns
    whose names the operators use themselves."""
    long = " ".join(f"word{i % 700} text" for i in range(60_000))
    rows = [
        (1, "The same short text, twice here.", "en", "a", 5), (2, "The same short text, twice here.", "en", "b", 5), (2, "The same short text, twice here.", "en", "b", 5),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, long, "en", "c", 1), (None, "No id at all.", "de", "a", 2), (6, " \n\t ", "fr", "a", 3),
        (7, "ñandú \U0001f600 naïve\nline two", "es", "b", 4), (8, "x" * 5000, "en", "a", 9),
    ]
    df = spark.createDataFrame(rows, DOC)
    clash = ["id", "fp", "unit", "row", "h", "ids", "block", "spans", "score", "label", "component", "words", "start", "length"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
