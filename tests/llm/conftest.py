import itertools

import pytest

NUMBER = itertools.count()


@pytest.fixture
def rows(spark):
    """rows(schema, data): a DataFrame; also of no rows at all."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
