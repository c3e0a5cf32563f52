import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from paperflow.session import local_session, tune

    session = tune(local_session("8", "tests"))
    yield session
    session.stop()
