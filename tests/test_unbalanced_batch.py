"""Unbalanced distances of many pairs at once, against one pair at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from shapespark.functions import gromov
from shapespark.operators import pairs


@pytest.mark.parametrize(("rho", "eps", "tol"), [(0.1, 0.5, 0.4), (2.0, 0.05, 1e-3), (1e-3, 1e-5, 0.4)])
def test_batches_are_pairs_one_by_one(rho, eps, tol):
    rng = np.random.default_rng(7)
    found, want = [], []
    sides = [[], [], [], []]
    for k in range(30):
        one = []
        for s, n in enumerate((6, 8)):
            points = rng.normal(size=(n, 3)) * (1 + k % 4)
            mass = np.full(n, 1.0) if k % 2 else rng.random(n) + 0.05
            one.append(gromov.Space(np.linalg.norm(points[:, None] - points[None], axis=2), mass / mass.sum()))
            sides[2 * s].append(one[-1].d)
            sides[2 * s + 1].append(one[-1].mass)
        want.append(gromov.unbalanced_gw(*one, rho, rho, eps, tol=tol))
    found = gromov.unbalanced_batch(*map(np.stack, sides), rho, rho, eps, tol=tol)
    for f, w in zip(found, want, strict=True):
        assert (f.gw, f.kl_x, f.kl_y, f.kl_plan, f.total, f.value, f.eps) == pytest.approx((w.gw, w.kl_x, w.kl_y, w.kl_plan, w.total, w.value, w.eps), rel=1e-7, abs=1e-9)
        assert f.plan == pytest.approx(w.plan, rel=1e-6, abs=1e-9)


def test_pairs_are_not_solved_alone(monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for k, n in enumerate((5, 5, 7, 5, 7)):
        points = rng.normal(size=(n, 2))
        i, j = np.triu_indices(n, 1)
        rows.append((f"s{k}", n, np.linalg.norm(points[i] - points[j], axis=1), np.full(n, 1.0 / n)))
    table = pd.DataFrame(rows, columns=["id", "n", "d", "mass"])
    spaces = dict(zip(table.id, pairs.spaces_of(table), strict=True))
    want = {(x, y): gromov.unbalanced_gw(spaces[x], spaces[y], 0.3, 0.3, 0.2).value for x in spaces for y in spaces if x < y}
    taken = {}
    monkeypatch.setattr(pairs, "by_blocks", lambda spaces, kernel, *_, **__: taken.setdefault("kernel", kernel))
    pairs.unbalanced_pairwise(None, 0.8, 0.2, rho=0.3)

    def alone(*_, **__):
        raise AssertionError("a pair is solved alone")

    monkeypatch.setattr(gromov, "unbalanced_gw", alone)
    for a, b in ((table, None), (table.iloc[3:], table.iloc[:3])):
        found = taken["kernel"](a, b)
        assert len(found) == (10 if b is None else 6)
        assert all(r.value == pytest.approx(want[r.first, r.second], rel=1e-9) for r in found.itertuples())
