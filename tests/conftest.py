import pytest

from fogline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, **{"spark.driver.memory": "8g", "spark.sql.ui.retainedExecutions": "5", "spark.ui.retainedJobs": "50", "spark.ui.retainedStages": "50", "spark.ui.retainedTasks": "1000", "spark.checkpoint.dir": "/tmp/fogline-tests", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
