"""Every registered query against its SQL twin, over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tallyhouse import catalog
from tallyhouse.plans.warehouse import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(" ")[:19]
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_twin(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_survives_without_the_corpus_half(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
