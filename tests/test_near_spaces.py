"""Scores over near pairs of spaces, against those from the table of all their distances; edges are neither written nor collected."""

from __future__ import annotations

import pytest

from shapespark.operators import pairs, statistics
from shapespark.plans import catalog, views

from .conftest import SF

SCORES = {"laplacian_score": lambda f, d: statistics.laplacian_scores(f, d, 0.012), "association": lambda f, d: statistics.association(f, d, 0.012, 200)}


@pytest.mark.parametrize("name", SCORES)
def test_scores_are_those_of_all_distances(spark, monkeypatch, name):
    want = {r["name"]: r.asDict() for r in SCORES[name](catalog.one_hot(spark, SF), catalog.all_bounds(spark, SF)).collect()}

    def no_edges(*_):
        raise AssertionError("the edges are made")

    monkeypatch.setattr(statistics, "neighbourhood", no_edges)
    monkeypatch.setattr(catalog, "all_bounds", no_edges)
    found = {r["name"]: r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()}
    assert found.keys() == want.keys()
    for k, row in found.items():
        assert row.pop("score") == pytest.approx(want[k].pop("score"), abs=1e-6)
        assert row == want[k]


def test_regressions_are_those_of_all_distances(spark, monkeypatch):
    few = views.vectors(spark, SF).selectExpr("id obj", "'x' name", "vector[0] value")
    want = {r["name"]: r for r in statistics.association(catalog.one_hot(spark, SF), catalog.all_bounds(spark, SF), 0.012, 200, few).collect()}
    monkeypatch.setattr(catalog, "all_bounds", None)
    for r in catalog.QUERIES["association_covariates"](spark, SF).collect():
        for c in ("score", "p", "q", "beta", "beta_p", "f_p", "p_adjusted", "q_adjusted"):
            assert r[c] == pytest.approx(want[r["name"]][c], rel=1e-6, abs=1e-9), c


def test_near_spaces_of_unequal_sizes(spark):
    rows = [(f"s{k}", n, [0.1 * (k + i) for i in range(n * (n - 1) // 2)]) for k, n in enumerate((3, 4, 3, 4, 5))]
    icdm = spark.createDataFrame(rows, "cell_id string, n int, d array<double>")
    bounds = {(r["first"], r["second"]): r.slb for r in pairs.slb_uniform(icdm).collect()}
    below = sum(sorted(bounds.values())[4:6]) / 2
    near = {r.id: r.near for r in pairs.near_sums(pairs.ranked(icdm).selectExpr("id", "n", "d", "array(1D) f"), below, 1).collect()}
    assert near == {name: sum(name in k and v < below for k, v in bounds.items()) for name, *_ in rows}
