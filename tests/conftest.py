import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from daygrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def days(start: str, n: int) -> list[dt.date]:
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(n)]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
