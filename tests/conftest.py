import pytest

from rivaq.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    import os

    folder = os.environ.get("RIVAQ_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    return folder
