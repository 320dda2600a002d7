import pytest

from redliner.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, **{"spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    yield session
    session.stop()
