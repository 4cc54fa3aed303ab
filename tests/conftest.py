from __future__ import annotations

import pytest

from hygroflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", partitions=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
