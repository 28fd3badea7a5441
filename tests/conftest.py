import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from filinglens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app_name="filinglens-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def tmp_table(spark):
    """A fresh folder under the session's checkpoint folder."""
    from filinglens.session import scratch_path

    return lambda name: scratch_path(spark, name)
