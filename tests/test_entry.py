"""The entry module works without the optional subpackage and pipeline."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("paperloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "summary_workspace" in q and "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in q)
assert set(e.oracle_sql()) <= set(q)
"""


def test_without_optional():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_imports_it():
    for p in (ROOT / "paperloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
