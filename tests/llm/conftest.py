import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_cases import SCHEMA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above, with extra columns whose names clash with those of results."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
