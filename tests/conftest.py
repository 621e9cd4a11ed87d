import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from airwell.session import build_session
    extra = {"spark.ui.enabled": "false"}
    s = build_session("local[4]", app="airwell-tests", shuffle_partitions=4, extra=extra)
    # tests set their own shared folder only where the session has none
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="airwell-test-"))
    yield s
    s.stop()
