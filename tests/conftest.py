"""One local session for all tests, with a checkpoint folder of its own."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillspark.session import build

    conf = {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = build("local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
