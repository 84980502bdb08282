import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks import compare, views  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return compare.session(4)


@pytest.fixture(scope="session")
def duck():
    return compare.reference(SF)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def commits(spark):
    return views.commits(spark, SF)


@pytest.fixture
def values(spark):
    """Evaluate a Column function over a list of inputs in one query."""

    def run(kind, inputs, *functions):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
        rows = df.select("i", *[f("x").alias(f"r{n}") for n, f in enumerate(functions)])
        got = [tuple(r)[1:] for r in sorted(rows.collect())]
        return [r[0] for r in got] if len(functions) == 1 else got

    return run
