"""The entry module with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import sys
sys.path.insert(0, {root!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "tasklens.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "A5_task_index_stats" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
assert set(e.oracle_sql()) <= names
"""

BROKEN = """
import sys
sys.path.insert(0, {root!r})
class Broken:
    def find_spec(self, name, path=None, target=None):
        if name == "xxhash":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Broken())
try:
    import __spark_entry__
except ModuleNotFoundError as e:
    assert e.name == "xxhash"
else:
    import importlib.util
    assert importlib.util.find_spec("tasklens.llm") is None     # nothing there to break
"""


def run(code):
    subprocess.run([sys.executable, "-c", code.format(root=ROOT)], check=True, cwd="/", timeout=120)


def test_queries_without_the_subpackage():
    run(WITHOUT)


def test_other_import_errors_are_not_hidden():
    run(BROKEN)
