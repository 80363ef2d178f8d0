"""The driver contract and the catalog's SQL."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from shapespark.plans import catalog, oracles
from tests.conftest import ROOT, SF

#: Queries over all pairs of all vectors are left to the driver's own comparison.
LARGE = {"slb_uniform", "laplacian_score", "wnn"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert set(oracles.ORACLES) <= set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["first", "second", "dist", "method", "converged", "n_iter"] and found.count() > 0


def test_rest_works_without_the_optional_folders(tmp_path):
    for p in Path(ROOT).iterdir():
        if p.name in ("__spark_entry__.py", "shapespark"):
            subprocess.run(["cp", "-r", str(p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "shapespark/llm")], check=True)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'gw_pairwise' in names and 'pipeline' not in names and not any(n.startswith('op1') for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", sorted(set(oracles.ORACLES) - LARGE))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracles.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: repr(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row))
    assert sorted(key(r[c] for c in columns) for r in got.collect()) == sorted(map(key, want.select(*columns).fetchall()))
