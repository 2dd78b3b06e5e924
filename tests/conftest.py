import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from dutyflow.session import session

    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__default__parallelism="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples."""

    def get(df, *columns):
        got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(got, key=lambda t: tuple((x is not None, str(x)) for x in t))

    return get
