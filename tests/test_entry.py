"""The entry points without the parts that can be left out."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from contract.queries import QUERIES

WITHOUT = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(" ".join(sorted(entry.queries())))
assert set(entry.oracle_sql()) <= set(entry.queries())
"""


@pytest.mark.parametrize("names", [("veilframe.llm", "corpus_pipeline"), ("veilframe.llm",), ("ahocorasick",), ("public_tokenizers",), ("corpus_pipeline",)])
def test_other_queries_stand_alone(names):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", WITHOUT.format(names=names)], cwd=here, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    found = set(done.stdout.split())
    assert set(QUERIES) <= found
    assert "pipeline" not in found
    if names != ("corpus_pipeline",):
        assert found == set(QUERIES)
