from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakemeta.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def load_documents(spark, tmp_path):
    """Writes ``{connector: document}`` as discovery documents and reads them back."""
    from lakemeta.sources.snapshots import read_discovery_documents

    def load(documents: dict, name: str = "docs"):
        folder = tmp_path / name
        folder.mkdir()
        for connector, document in documents.items():
            text = document if isinstance(document, str) else json.dumps(document)
            (folder / f"{connector}.discovery.json").write_text(text)
        return read_discovery_documents(spark, str(folder))
    return load


@pytest.fixture
def connectors(spark):
    return spark.createDataFrame(
        [("test-pg", "POSTGRESQL"), ("test-mssql", "MSSQL")],
        "connector_id STRING, database_type STRING")
