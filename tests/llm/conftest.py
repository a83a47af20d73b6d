import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def docs(spark):
    import cases

    return cases.documents(spark)


@pytest.fixture
def none(spark):
    import cases

    return spark.createDataFrame([], cases.SCHEMA)
