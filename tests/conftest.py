"""One session for all tests."""

import pytest

from codestrata.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 4, **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.default.parallelism": "2"})
