import pytest


@pytest.fixture(scope="module")
def make(spark):
    """Documents from (doc_id, text, source) rows, with a column whose name the operators use themselves."""

    def build(rows, schema="doc_id long, text string, source string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumns({"lang": F.lit("en"), "n": F.lit(1), "id": F.lit("x"), "node": F.lit(2.5)}).repartition(3)

    return build
