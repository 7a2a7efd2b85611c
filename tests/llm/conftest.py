import pytest

from odd_tables import SCHEMA, documents


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
