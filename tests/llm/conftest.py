import pytest


@pytest.fixture(scope="session", autouse=True)
def code_on_workers(spark):
    from outpulse.llm.common import ship

    ship(spark)


@pytest.fixture
def as_table(spark, tmp_path):
    """Rows written as Parquet and read again, as operators number the rows of files."""

    def build(rows, schema, name="t"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return build
