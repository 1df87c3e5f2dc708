import os

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g --conf spark.ui.showConsoleProgress=false pyspark-shell")
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
