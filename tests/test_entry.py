"""The driver's contract: entry, queries, SQL, and life without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_custkey", "yr", "wins", "losses", "total", "win_rate", "rnk"]
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_imports_without_the_optional_parts():
    code = """
import sys
class Gone:
    def find_spec(self, name, *rest):
        if name == "corpus_pipeline" or name.startswith("tallyspark.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in e.queries())
print(len(e.queries()), len(e.oracle_sql()))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 100


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tallyspark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
