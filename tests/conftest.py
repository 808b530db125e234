import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import build

    session = build("tests", "local[4]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
