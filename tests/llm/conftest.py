import pytest


@pytest.fixture
def table(spark):
    """A table from rows and a schema, in several partitions."""
    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
