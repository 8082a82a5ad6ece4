import pytest

from quire.llm.queries import importable


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)
