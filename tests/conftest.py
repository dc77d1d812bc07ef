import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pagegraph.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to a list of rows (tuples or scalars) and give the results in order."""

    def run(function, rows, schema="a string"):
        data = [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
        df = spark.createDataFrame(data, "i int, " + schema)
        columns = [df[c] for c in df.columns[1:]]
        return [r[1] for r in df.select("i", function(*columns)).orderBy("i").collect()]

    return run
