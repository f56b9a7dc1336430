import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("colscope-tests", 4, spark__sql__shuffle__partitions="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
