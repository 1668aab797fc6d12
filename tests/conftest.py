import pytest

from repolore.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
