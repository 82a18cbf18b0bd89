import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wattlens.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app_name="wattlens-tests")
    yield s
    s.stop()


def rows(df, order=None):
    """Collect as a sorted list of tuples (order-insensitive comparisons)."""
    data = [tuple(r) for r in df.collect()]
    return sorted(data, key=lambda t: tuple((x is None, str(x)) for x in t))
