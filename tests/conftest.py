import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    os.environ.setdefault("QUERN_TEST_KEY", "k" * 40)
    session = local_session(8)
    yield session
    session.stop()
