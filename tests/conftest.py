import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    made = session(
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "1m"},
    )
    made.sparkContext.setLogLevel("ERROR")
    return made
