import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as a DataFrame over a few partitions."""

    def make(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(list(rows), schema).repartition(parts)

    return make
