import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lumenquery.session import build_session

    s = build_session("tests", cpus=8, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
