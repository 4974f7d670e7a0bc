import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tagbill.session import build_session, ensure_checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="tagbill-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
