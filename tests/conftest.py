import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over literal inputs."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        schema = ", ".join(f"c{i} {kind(v)}" for i, v in enumerate(values))
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]

    def kind(v):
        return {bool: "boolean", int: "bigint", float: "double"}.get(type(v), "string")

    return run
