import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lathe.session import local_session

    s = local_session("*", shuffle_partitions=8, app="lathe-tests")
    # a zone with DST catches session-zone leaks into timestamp_ntz arithmetic
    s.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
