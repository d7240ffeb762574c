from __future__ import annotations

import pytest

from wardline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
