import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from opsframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    checkpoints = tmp_path_factory.mktemp("checkpoints")
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        4,
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(checkpoints),
        spark__sql__warehouse__dir=str(warehouse),
    )
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """A path below the test's own folder."""
    return lambda name: str(tmp_path / name)
