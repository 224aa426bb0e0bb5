import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestone.session import local_session  # noqa: E402
from lodestone.sources.tables import corpus_from_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", **{"spark.sql.shuffle.partitions": "4"})
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    yield session


@pytest.fixture
def corpus(spark):
    """Build files from ``{path: text}``, optionally under several corpora."""

    def build(texts, corpus_id="p", root=""):
        rows = [(corpus_id, root, path, text) for path, text in texts.items()]
        df = spark.createDataFrame(rows, "corpus string, top string, name string, body string")
        return corpus_from_table(df, "name", "body", corpus_id="corpus", root="top")

    return build
