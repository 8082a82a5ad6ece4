import shutil
import subprocess
import sys
from pathlib import Path

from quire.plans import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_queries_without_the_optional_subpackage(tmp_path):
    """In a copy without the subpackage and its tests, pipeline file left in place."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in ("quire", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sorted(q) == sorted(__import__('quire.plans', fromlist=['QUERIES']).QUERIES)); import tests.test_queries"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "True"], done.stderr
