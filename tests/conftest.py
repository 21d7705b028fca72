import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lamella.sources.tables import session

    s = session(8, "tests", **{"spark.sql.shuffle.partitions": "8", "spark.local.dir": tempfile.mkdtemp(prefix="spark-"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    yield s
    s.stop()
