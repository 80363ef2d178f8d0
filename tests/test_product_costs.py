"""Descents of pairs with equal masses: the first assignment by order, and no work of Python for each pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shapespark.functions import gromov, transport
from shapespark.functions.gromov import Space
from shapespark.operators import graphs, pairs
from shapespark.plans import catalog

from .conftest import SF

rng = np.random.default_rng(11)


def test_products_are_assigned_as_by_the_solver():
    for n in (1, 2, 9):
        x, y = rng.normal(size=(40, n)), rng.normal(size=(40, n))
        x[:10], y[5:15] = rng.integers(0, 2, (10, n)), rng.integers(0, 2, (10, n))  # with ties
        cost = -2.0 * x[:, :, None] * y[:, None]
        columns, v = transport.assign_products(x, y)
        assert (columns == transport.assign(cost)[0]).all()
        # no row is better off with another column
        reduced = cost - v[:, None]
        assert np.allclose(np.take_along_axis(reduced, columns[:, :, None], axis=2)[:, :, 0], reduced.min(axis=2))


def test_no_pair_is_solved_alone(monkeypatch):
    points = rng.normal(size=(12, 7, 3))
    d = np.sqrt(((points[:, :, None] - points[:, None]) ** 2).sum(axis=3))
    upper = np.triu_indices(7, 1)
    table = pd.DataFrame({"id": [f"s{k:02d}" for k in range(12)], "n": 7, "d": [x[upper] for x in d], "mass": [np.full(7, 1 / 7)] * 12})
    calls, batch = [], gromov.descend_batch
    monkeypatch.setattr(gromov, "descend_batch", lambda a, b: (calls.append(len(a)), batch(a, b))[1])
    monkeypatch.setattr(gromov, "assign", lambda costs, duals: (transport.assign(costs, duals) if duals is not None else pytest.fail("first step by the solver")))
    found = pairs.gw_kernel(table[6:], table[:6], True)
    assert calls == [36] and (found["first"] < found["second"]).all()
    for r in found.itertuples():
        x, y = (Space(d[int(name[1:])], np.full(7, 1 / 7)) for name in (r.first, r.second))
        one = gromov.gw(x, y)
        assert r.dist == pytest.approx(one.dist, abs=1e-12) and (r.converged, r.n_iter) == (one.converged, one.steps)
        assert (one.plan[r.i, r.j] == r.mass).all()


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_couplings_are_counted_without_a_shuffle_of_pairs(spark):
    assert shuffles(catalog.QUERIES["gw_couplings"](spark, SF)) <= 2
    spaces = catalog.nations(spark, SF)
    found = pairs.gw_pairwise(spaces, True)
    want = pairs.couplings(found).groupBy("first", "second").agg(F.count("*"), F.sum("mass")).collect()
    got = {r[:2]: r[2:] for r in pairs.coupling_sizes(found).collect()}
    assert len(got) == len(want) and all(got[r[:2]] == pytest.approx(r[2:]) for r in want)


def test_deformations_meet_no_written_plans(spark):
    for spaces in (catalog.nations(spark, SF), catalog.views.weighted_nation_spaces(spark, SF)):
        spaces = catalog.materialise(spaces, "nations")
        found = graphs.deformations_of_spaces(spaces)
        assert shuffles(found) <= 2
        want = {r[:4]: r.amount for r in graphs.deformations(spaces, pairs.gw_pairwise(spaces, True)).collect()}
        got = {r[:4]: r.amount for r in found.collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
