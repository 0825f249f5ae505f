import pytest

from grainfield.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
