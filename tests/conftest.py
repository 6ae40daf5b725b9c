import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plantcast.catalog import models  # noqa: E402
from plantcast.session import local_session  # noqa: E402
from plantcast.sources.casting import PlanningTables  # noqa: E402

# The registered queries take the published settings; tests fit small models.
models.OVERRIDES.update(boosted={"maxIter": 5}, forest={"numTrees": 5, "maxDepth": 6})
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("*")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return PlanningTables(spark, FOLDER)
