import pytest

from tallywren.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", "4", 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
