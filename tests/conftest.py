import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
# Python workers import the package and the tests' stubs as well.
for folder in (HERE.parent, HERE):
    sys.path.insert(0, str(folder))
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
