import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marlstone.session import session

    s = session(4, partitions=4, memory="4g")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-tests-"))
    yield s
    s.stop()
