"""Solvers of many pairs at once, against those of one pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from shapespark.functions import gromov, transport
from shapespark.functions.gromov import Space
from shapespark.operators import pairs

rng = np.random.default_rng(7)


def space(n: int, even: bool) -> Space:
    points = rng.normal(size=(n, 3))
    mass = np.ones(n) if even else rng.integers(1, 5, n).astype(float)
    return Space(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)), mass / mass.sum())


def rows(spaces: list[Space], prefix: str) -> pd.DataFrame:
    upper = [s.d[np.triu_indices(len(s.mass), 1)] for s in spaces]
    return pd.DataFrame({"id": [f"{prefix}{k}" for k in range(len(spaces))], "n": [len(s.mass) for s in spaces], "d": upper, "mass": [s.mass for s in spaces], "kinds": [np.arange(len(s.mass)) % 4 + 1 for s in spaces]})


def test_flows_are_optimal():
    for n, m in ((1, 1), (1, 5), (6, 4), (9, 9)):
        a, b = rng.integers(1, 6, (20, n)).astype(float), rng.integers(1, 6, (20, m)).astype(float)
        a, b = a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True)
        # half of the problems have costs of few integers, so that many tie
        cost = np.concatenate([rng.normal(size=(10, n, m)), rng.integers(0, 3, (10, n, m)).astype(float)])
        first, duals = transport.flow_batch(a, b, cost + rng.normal(size=cost.shape))
        assert np.allclose(first.sum(axis=2), a, atol=1e-12)
        plans, _ = transport.flow_batch(a, b, cost, duals)
        assert (plans >= 0).all() and np.allclose(plans.sum(axis=2), a, atol=1e-12) and np.allclose(plans.sum(axis=1), b, atol=1e-12)
        for x, y, c, p in zip(a, b, cost, plans, strict=True):
            assert (p * c).sum() == pytest.approx(transport.emd_cost(x, y, c), abs=1e-9)


def test_distances_of_unequal_masses(monkeypatch):
    spaces = [space(n, even) for n, even in ((8, False), (8, True), (5, False), (5, True), (8, False))]
    want = {(f"s{i}", f"s{j}"): gromov.gw(spaces[i], spaces[j]) for i in range(5) for j in range(i + 1, 5)}
    monkeypatch.setattr(pairs.gromov, "gw", None)  # none is solved alone
    found = pairs.gw_kernel(rows(spaces, "s"), None, plans=True)
    assert len(found) == len(want)
    for r in found.itertuples():
        one = want[r.first, r.second]
        assert r.dist == pytest.approx(one.dist, abs=1e-9) and (r.converged, r.n_iter) == (one.converged, one.steps)
        assert sum(r.mass) == pytest.approx(1.0)


@pytest.mark.parametrize("worst", [None, 0.1])
def test_fused_distances(spark, monkeypatch, worst):
    rules = pairs.kind_penalties(1.0, 0.5)
    spaces = [space(n, even) for n, even in ((8, True), (8, True), (8, True), (5, True), (8, False))]
    table = rows(spaces, "s")
    want = {}
    for i in range(5):
        for j in range(i + 1, 5):
            feature = gromov.penalty_matrix(rules, table.kinds[i], table.kinds[j])
            one, quadratic, linear = gromov.fused_with_budget(spaces[i], spaces[j], feature, worst)
            want[f"s{i}", f"s{j}"] = (one.dist, quadratic, linear, one.converged)
    taken = {}
    monkeypatch.setattr(pairs, "by_blocks", lambda spaces, kernel, *_, **__: taken.setdefault("kernel", kernel))
    pairs.fused_pairwise(None, rules, worst)
    alone, single = [], gromov.fused_with_budget
    monkeypatch.setattr(pairs.gromov, "fused_with_budget", lambda *a: (alone.append(1), single(*a))[1])
    found = taken["kernel"](table, None)
    assert len(found) == len(want) and len(alone) == 7  # the three pairs of equal size and masses are solved together
    for r in found.itertuples():
        assert r[3:] == pytest.approx(want[r.first, r.second], abs=1e-9)


def test_quantised_distances(monkeypatch):
    spaces = [space(n, even) for n, even in ((9, False), (9, True), (7, False), (4, True), (4, True))]
    cut = [pairs.quantised(r, 4) for r in rows(spaces, "s").to_dict("records")]
    met = [(cut[i], cut[j]) for i in range(5) for j in range(i + 1, 5)]
    want = [gromov.quantised_gw(x, y) for x, y in met]
    alone, single = [], gromov.gw
    monkeypatch.setattr(gromov, "gw", lambda *a: (alone.append(1), single(*a))[1])
    coarse = gromov.medoids_batch(met)
    assert len(alone) == 1  # the last pair has equal masses; all others are solved together
    for (x, y), c, w in zip(met, coarse, want, strict=True):
        found = gromov.quantised_gw(x, y, c)
        assert found.dist == pytest.approx(w.dist, abs=1e-9) and (found.converged, found.steps) == (w.converged, w.steps)
