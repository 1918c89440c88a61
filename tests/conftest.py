import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from graphmill.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}/checkpoints",
        spark__sql__warehouse__dir=f"file://{shared}/warehouse", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
