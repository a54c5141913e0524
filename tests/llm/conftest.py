import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of (doc_id, text) as documents, with extra columns whose names clash with the operators' own."""

    def make(pairs, **extra):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, None if i is None or i % 5 == 3 else f"s{i % 3}", "en") for i, t in pairs], "doc_id long, text string, source string, lang string")
        for c in ("key", "h", "n", "name", "words", "at", "rid", "score", "fp", "k", "row"):
            df = df.withColumn(c, F.lit("x"))
        return df

    return make
