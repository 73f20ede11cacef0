"""Every registered query against its SQL, on the smallest tables; queries without SQL must run and have rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_small, con):
    df = catalog.QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("tessera/llm",), ("tessera/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_registry_without_the_corpus_operators(gone, tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    for name in ("tessera", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in gone:
        where = tmp_path / name
        shutil.rmtree(where) if where.is_dir() else where.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'chunks_fixed' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # the copied tree alone
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
