import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from affinium.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
