import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallygrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, "tests", partitions=4, shared=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture(params=["one cell", "cells"])
def plans(request, spark):
    """Run a test with one cell and with eight."""
    if request.param == "cells":
        spark.conf.set("tallygrid.rowsPerTask", "0")
    yield request.param
    spark.conf.unset("tallygrid.rowsPerTask")


@pytest.fixture
def approx_rows():
    def check(df, expected, order=None, tol=1e-9):
        got = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
        assert len(got) == len(expected), got
        for g, e in zip(got, expected):
            for a, b in zip(g, e):
                if isinstance(b, float):
                    assert a == pytest.approx(b, abs=tol, rel=tol), (g, e)
                else:
                    assert a == b, (g, e)

    return check
