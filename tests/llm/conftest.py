import pytest

from carelake.llm.common import importable


@pytest.fixture(scope="session")
def sp(spark):
    return importable(spark)
