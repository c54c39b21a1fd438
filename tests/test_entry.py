"""The entry point works with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("veritab.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), sorted(n for n in e.queries() if n.startswith("op") or n == "pipeline"), set(e.oracle_sql()) <= set(e.queries()))
"""


def test_without_the_subpackage():
    out = subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, rest = out.stdout.split(" ", 1)
    assert int(n) >= 126 and rest.strip() == "[] True", out.stderr


def test_without_what_the_subpackage_needs():
    code = BLOCKED.replace('name == "corpus_pipeline" or name.startswith("veritab.llm")', 'name == "tiktoken"')
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, rest = out.stdout.split(" ", 1)
    assert int(n) >= 126 and rest.strip() == "[] True", out.stderr


def test_nothing_else_imports_the_subpackage():
    own = [p for p in ROOT.glob("veritab/**/*.py") if "llm" not in p.parts]
    assert len(own) > 20 and not any("veritab.llm" in p.read_text() or "import llm" in p.read_text() for p in own)
