from __future__ import annotations

import pytest

from tillwise.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("checkpoints")
    built = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(scratch),
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
