from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ferrylog.session import build_session  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[8]", spark__driver__memory="8g")
    session.sparkContext.setCheckpointDir(str(shared))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
