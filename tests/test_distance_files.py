"""A file of distances that has each pair once: what it takes on disk, and that nothing but names is shuffled to read it."""

from __future__ import annotations

from pathlib import Path

from shapespark.plans import catalog
from shapespark.sources import tables

from .conftest import SF


def test_roundtrip_writes_pairs_once_and_compressed(spark, monkeypatch):
    folders, plans = [], []
    write, symmetric = tables.write_distances, tables.symmetric
    monkeypatch.setattr(tables, "write_distances", lambda df, path, *a: (folders.append(path), write(df, path, *a)))
    monkeypatch.setattr(tables, "symmetric", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), symmetric(df))[1])
    monkeypatch.setattr(catalog, "materialise", None)  # no second table of the pairs
    found = catalog.QUERIES["distances_roundtrip"](spark, SF)
    rows = found.collect()
    files = [p for p in Path(folders[0].removeprefix("file://")).iterdir() if p.name.startswith("part-")]
    n = sum(r["first"] < r["second"] for r in rows)
    assert n and len({(r["first"], r["second"]) for r in rows}) == len(rows)
    assert all(p.name.endswith(".csv.gz") for p in files) and sum(p.stat().st_size for p in files) < 15 * n
    assert "Exchange" not in plans[0]


def test_both_readers_agree(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "a", 0.5), ("a", "c", 1.25), ("c", "b", 2.0)], "first string, second string, dist double")
    tables.write_distances(pairs, f"{tmp_path}/plain")
    tables.write_distances(pairs, f"{tmp_path}/packed", "gzip")
    want = {("a", "b", 0.5), ("a", "c", 1.25), ("b", "c", 2.0)}
    for path in ("plain", "packed"):
        for distinct in (False, True):
            assert set(map(tuple, tables.read_distances(spark, f"{tmp_path}/{path}", distinct=distinct).collect())) == want
    both = sorted(map(tuple, tables.symmetric(pairs).collect()))
    assert both == sorted([*((a, b, d) for a, b, d in map(tuple, pairs.collect())), *((b, a, d) for a, b, d in map(tuple, pairs.collect())), *((x, x, 0.0) for x in "abc")])
