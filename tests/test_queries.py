"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lodestone import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    return "null" if v is None or v != v else repr(float(v)) if isinstance(v, (float, Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, DATA)
    want = db.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("gone", [("lodestone/llm", "tests/llm"), ("lodestone/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_works_without_the_training_data_operators(tmp_path, gone):
    root, copy = Path(__file__).resolve().parents[1], tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for p in gone:
        shutil.rmtree(copy / p) if (copy / p).is_dir() else (copy / p).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr
