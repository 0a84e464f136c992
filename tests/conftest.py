import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
