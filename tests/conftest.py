import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from refreshgate.session import build_session, remove_run_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(shuffle_partitions=4, spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_run_folder(session)
    session.stop()
