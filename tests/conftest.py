import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from calembour.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, "tests", "4g", spark__sql__shuffle__partitions=4, spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
