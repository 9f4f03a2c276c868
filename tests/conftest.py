import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "3g", shuffle_partitions=4)
    yield session


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Value on a single row."""
    row = spark.range(1)

    def run(v):
        return row.select(v.alias("x")).first()[0]

    return run
