import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from flipframe.session import build_session, drop_scratch

    s = build_session("local[*]", 8, app="flipframe-tests")
    yield s
    drop_scratch(s)
    s.stop()
