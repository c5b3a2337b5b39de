import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from fleetfold.session import build_session  # noqa: E402

SAMPLE = os.environ.get("FLEETFOLD_SAMPLE", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample():
    return SAMPLE


@pytest.fixture(scope="session")
def duck(sample):
    from oracle import connect

    return connect(sample)
