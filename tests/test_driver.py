"""The driver's contract holds with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("weirstone.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
if {gone}:
    sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), any(n.startswith("op") and n[2].isdigit() for n in e.queries()))
"""


def said(gone):
    return subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_subpackage():
    n, held, extra = said(True)
    assert int(n) > 45 and held == "True" and extra == "False"


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "weirstone").rglob("*.py"):
        if "llm" not in path.parts:
            assert "weirstone.llm" not in path.read_text(encoding="utf-8"), path
    assert "weirstone.llm" not in (ROOT / "bench.py").read_text(encoding="utf-8")
