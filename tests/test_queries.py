"""Every registered query of the fact engine against its SQL on the smallest tables; and the driver's contract."""

import glob
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, tables, name):
    df = core.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    want = tables.execute(core.ORACLE[name])
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(d[0] for d in want.description) == names
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_contract(spark):
    assert entry.entry(spark).columns == ["ok", "any_absent", "n", "lhs", "rhs"]
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_without_the_text_operators(tmp_path):
    """A copy without the subpackage and its tests: the entry point has all other queries, with and without the pipeline's file."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    shutil.copytree(os.path.join(root, "ledgerloom"), tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    for _ in range(2):
        got = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True).stdout.splitlines()
        assert got[-2:] == [" ".join(sorted(core.QUERIES)), " ".join(sorted(core.ORACLE))]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_nothing_else_imports_the_text_operators():
    root = os.path.dirname(os.path.abspath(core.__file__))
    files = [f for f in glob.glob(f"{root}/**/*.py", recursive=True) if f"{os.sep}llm{os.sep}" not in f]
    assert files and not [f for f in files if re.search(r"^\s*(from|import)\s.*\bllm\b", open(f).read(), re.M)]
