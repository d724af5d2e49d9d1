import os
import shutil
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ.setdefault("CALLWEAVE_DRIVER_MEMORY", "4g")

from callweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4, app="tests")
    shared = tempfile.mkdtemp(prefix="callweave-tests-")
    session.sparkContext.setCheckpointDir(shared)
    yield session
    session.stop()
    shutil.rmtree(shared, ignore_errors=True)
