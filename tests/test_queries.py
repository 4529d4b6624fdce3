"""Every registered query: it runs with a stable schema, and where SQL is given, it gives the SQL's rows."""

import glob
import math
import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x) if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        return
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in cursor.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["i", "j", "p"]


def test_rest_works_without_the_subpackage(tmp_path):
    """Both folders deleted: the entry registers the other queries, and every other test module still imports."""
    bare = tmp_path / "repo"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    assert not (bare / "statewise" / "llm").exists() and not (bare / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=bare, capture_output=True, check=True, timeout=300)
    said = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=bare, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and "p3_found" in said.stdout and "p1_found" not in said.stdout
