import pytest

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names operators use inside."""
    def make(rows, clash=True):
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            df = df.selectExpr("doc_id", "text", "'x' AS h", "1 AS node", "2 AS fp", "'y' AS row", "3 AS n", "0 AS pos",
                               "'en' AS lang", "true AS kept")
        return df
    return make


EDGE = [(1, None), (2, ""), (3, "   \n\n "), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "w" * 70_000),
        (6, "tie tie tie tie"), (7, "tie tie tie tie")]
