import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(Path(__file__).parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    """Rows of a driver table as tuples of the named columns."""

    def read(name, *columns):
        return [tuple(r) for r in spark.read.parquet("{}/{}.parquet".format(SF, name)).select(*columns).collect()]

    return read


@pytest.fixture(scope="session")
def rows():
    def collect(df, *columns):
        return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)

    return collect
