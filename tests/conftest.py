from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import local_session

    session = local_session(cpus=8, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    from compare import SF_DIR

    return SF_DIR
