"""Fixtures of the training-data tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_plain import SCHEMA, odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    clash = {c: F.lit(1) for c in ("node", "size", "path", "a", "b", "n", "block", "rank", "length", "part", "kept", "component", "score", "word", "row", "digest", "first", "toxic", "predicted", "seeds", "copy", "links", "count")}
    return spark.createDataFrame(odd_documents(), SCHEMA).withColumns(clash).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
