"""One local session for all tests."""

import pytest

from stratagraph.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = get_session(
        "tests", master="local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{shared}", spark__sql__autoBroadcastJoinThreshold="256k",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
