import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", "s", 1, 0.5, True) for i, t in rows],
            "doc_id long, text string, lang string, source string, row long, score double, "
            "kept boolean")

    return make


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
