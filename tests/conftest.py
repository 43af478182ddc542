import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cairn.session import local_session, release_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shuffle_partitions=4, app="cairn-tests", shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    release_scratch(session)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
