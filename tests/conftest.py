import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from atomsift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def workdir():
    """A fresh folder that is left in place."""
    return tempfile.mkdtemp(prefix="atomsift-test-")


@pytest.fixture(scope="session")
def matrix_of(spark):
    def build(rows, first=0):
        data = [(first + i, [float(v) for v in r]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "row_id bigint, x array<double>")

    return build
