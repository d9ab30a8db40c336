import pytest

from quarry.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return get_session("local[4]", 4, extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
