"""The library stands without the pipeline subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

PROGRAM = r"""
import re
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("screenlab.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "lineage_summary" in names and not any(re.match(r"op\d+_", n) or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_imports_without_the_subpackage():
    subprocess.run([sys.executable, "-c", PROGRAM], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "screenlab").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
