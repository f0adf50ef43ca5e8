import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from roster.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", cores=8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session


@pytest.fixture
def apply(spark):
    """Values of a column function over a list of values, in order."""

    def run(function, values, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        return [r[0] for r in rows.select(function("x").alias("y"), "i").orderBy("i").select("y").collect()]

    return run
