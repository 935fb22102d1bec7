"""The driver's entry points where optional parts or libraries are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
from reqlake import registry
assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
print(len(entry.queries()) - len(registry.QUERIES))
"""


@pytest.mark.parametrize("name", ["zstandard", "sentencepiece", "numpy", "pyarrow", "pandas", "reqlake.llm", "corpus_pipeline", "no_such_module"])
def test_core_queries_need_no_optional_part(name):
    found = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr[-2000:]
