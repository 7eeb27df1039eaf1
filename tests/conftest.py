import pytest

from alarmlake.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", shuffle_partitions=4, app="alarmlake-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
