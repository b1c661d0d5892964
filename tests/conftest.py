import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rillbook.session import local_session  # noqa: E402
from rillbook.sources.fixtures import Tables  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, shuffle_partitions=4, app="tests", checkpoint_dir=tempfile.mkdtemp(prefix="rillbook-tests-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="session")
def duck():
    from tools.oracle_check import connect

    return connect(SF)
