import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from railpulse.session import get_spark
    s = get_spark(app="railpulse-tests", master="local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="rp-tests-ckpt-")})
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="rp-test-")
