import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return session(8, str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    """A table of documents from texts; doc_id is the position."""

    def make(*texts, **columns):
        rows = [(i, text, *[values[i] for values in columns.values()]) for i, text in enumerate(texts)]
        schema = "doc_id long, text string" + "".join(f", {name} {kind}" for name, kind in KINDS.items() if name in columns)
        return spark.createDataFrame(rows, schema)

    return make


KINDS = {"methods": "array<string>", "countries": "array<string>", "embedding": "array<double>", "transform_method": "string"}
