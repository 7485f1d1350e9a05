import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark: SparkSession):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark: SparkSession):
    """Null and empty texts, repeated rows, a tie, a long text, a null id, clashing extra columns."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"),
        (6, long), (7, long), (None, "no number here"), (8, "123 456 --- !!!"), (9, "é"), (10, "x" * 5000),
    ]
    extra = "g string, bucket string, label int, kept int, score string, document string"
    return spark.createDataFrame(
        [(d, t, "en", "s", 0, "g", "b", 1, 2, "s", "d") for d, t in rows], f"{DOC}, {extra}"
    )


@pytest.fixture(scope="session")
def none(spark: SparkSession):
    return spark.createDataFrame([], DOC)
