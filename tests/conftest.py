import os

import pytest

from assaytrail.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_of():
    return "2026-09-28"
