import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from strataprobe.session import create_session

    session = create_session("tests", "local[4]", **{"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
