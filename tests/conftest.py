import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillspark.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "3", "spark.default.parallelism": "3", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    yield ship(s)
    s.stop()
