import pytest

from gaugeframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "gaugeframe-tests",
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
