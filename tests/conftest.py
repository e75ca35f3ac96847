import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from alertmill.session import build_session

    s = build_session("tests", "local[4]", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('scratch')}", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    def get(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, str(x)) for x in t])

    return get
