import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weft.session import local_session, ship

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture(scope="session")
def small():
    return SMALL
