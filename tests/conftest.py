import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from touchline.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app="touchline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    from touchline.sources.fixture_map import sport_tables
    return sport_tables(spark, SF_SMALL)


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
