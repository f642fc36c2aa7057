import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from duelframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", shuffle_partitions=2, parallelism=2)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

