from datetime import datetime

import pytest

from annolytics.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")), "spark.sql.maxMetadataStringLength": "10000"}
    )
    yield session
    session.stop()


@pytest.fixture
def now():
    return datetime(2024, 1, 31)
