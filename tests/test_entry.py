import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).parents[1]


def test_names_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) >= 120"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True, timeout=120)


def test_nothing_outside_imports_the_optional_parts():
    for f in (TOP / "arborq").rglob("*.py"):
        if "llm" not in f.relative_to(TOP).parts:
            assert "arborq.llm" not in f.read_text()
