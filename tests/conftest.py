import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from quire.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a Column function to a list of strings."""
    from pyspark.sql import functions as F

    def run(function, values, *more):
        rows = [(i, v, *(m[i] for m in more)) for i, v in enumerate(values)]
        schema = "i int, a string" + "".join(f", m{k} {'string' if isinstance(m[0], str) else 'int'}" for k, m in enumerate(more))
        df = spark.createDataFrame(rows, schema)
        columns = [F.col("a"), *[F.col(f"m{k}") for k in range(len(more))]]
        return [r[0] for r in df.select(function(*columns).alias("out"), "i").orderBy("i").collect()]

    return run
