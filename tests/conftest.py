import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lapsewise import plans
    from lapsewise.session import local_session

    session = local_session("tests", cores="4", partitions=4)
    plans.ship(session)
    yield session
    session.stop()
