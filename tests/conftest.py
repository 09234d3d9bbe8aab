from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import session  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def rows():
    """Collected rows as dictionaries, sorted by the named columns."""

    def collect(df, *order):
        out = [r.asDict() for r in df.collect()]
        return sorted(out, key=lambda r: tuple((r[c] is not None, r[c]) for c in order)) if order else out

    return collect
