"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from brindle.session import session

    made = session(4, "4g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
