import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilspan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("veilspan-tests", master="local[4]", **{
        "spark__ui__enabled": "false", "spark__sql__shuffle__partitions": "2",
        "spark__driver__memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)
