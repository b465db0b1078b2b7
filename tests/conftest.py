import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftwarden.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests")


@pytest.fixture
def content(spark):
    def make(*texts):
        return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")
    return make


@pytest.fixture
def rule():
    def make(name, pattern, ordinal=0, category="pii", severity="high", confidence="high", **more):
        return {"ordinal": ordinal, "name": name, "category": category, "match": pattern, "enabled": True,
                "severity": severity, "confidence": confidence, "min_entropy": None, "description": name,
                "reference": None, "tags": [category], "env_var": False, "binary": False, **more}
    return make
