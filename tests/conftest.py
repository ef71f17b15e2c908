import pytest

from ledgerwell.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
