import tempfile

import pytest

from rankweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8,
        8,
        **{
            "spark.driver.host": "127.0.0.1",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
            "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-"),
        },
    )
    yield session
    session.stop()
