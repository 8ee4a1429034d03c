import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from relspark.session import ensure_shared_folder, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("relspark-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    ensure_shared_folder(session)
    yield session
    session.stop()
