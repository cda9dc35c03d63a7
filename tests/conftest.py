import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(str(tmp_path_factory.mktemp("scratch")), 8, app="millrace-tests")
