import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from trenchline.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app="trenchline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def permits_small(spark):
    from trenchline.sources.fixtures import permits_from_tpch

    return permits_from_tpch(spark, SF_SMALL)
