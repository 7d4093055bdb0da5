import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, app="cohortlens-tests")
    yield s


def rows(df, *cols):
    """Collected rows as tuples (in the given column order)."""
    return [tuple(r[c] for c in cols) for r in df.collect()]
