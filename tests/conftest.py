import pytest

from docloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("docloom-tests", "local[8]", spark__sql__shuffle__partitions="3", spark__ui__enabled="false",
                      spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
