import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortweave.session import build_local

    session = build_local(4, memory="4g", partitions=4, name="tests")
    yield session
    session.stop()
