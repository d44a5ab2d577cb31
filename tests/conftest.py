import pytest

from fleetlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", shuffle_partitions=4, memory="4g", app="fleetlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
