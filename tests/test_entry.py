"""The entry points without the corpus operators or what these need."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys, warnings
warnings.simplefilter("ignore")
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {0!r} or name.startswith({0!r} + "."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names and len(names) > 100
print(any(n.startswith("op") and n[2].isdigit() for n in names) or "pipeline" in names)
"""


@pytest.mark.parametrize("missing", ["public_tokenizers", "nightloom.llm", "corpus_pipeline", "xxhash", "zstandard"])
def test_entry_without(missing):
    out = subprocess.run([sys.executable, "-c", CODE.format(missing)], cwd=HERE, capture_output=True, text=True)
    assert out.stdout.strip() == "False", out.stderr


def test_a_missing_core_module_is_an_error():
    out = subprocess.run([sys.executable, "-c", CODE.format("nightloom.operators.runs")], cwd=HERE, capture_output=True, text=True)
    assert out.returncode and "ImportError" in out.stderr or "ModuleNotFoundError" in out.stderr
