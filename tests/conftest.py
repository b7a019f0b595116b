"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from matchloom.plans.session import local_session, ship

    session = local_session(4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship(session)
    yield session
    session.stop()
