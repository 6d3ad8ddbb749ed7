import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rentalytics.session import build_session

    scratch = tempfile.mkdtemp(prefix="rentalytics-tests-")
    s = build_session("local[4]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
                             "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    yield s
    s.stop()
