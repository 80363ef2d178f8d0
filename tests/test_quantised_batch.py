"""Quantised distances of many pairs at once, against one pair at a time."""

from __future__ import annotations

import numpy as np
import pytest

from shapespark.functions import gromov
from shapespark.functions.clusters import centroid_linkage
from shapespark.operators import pairs


def test_batches_are_pairs_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    cut = []
    for n, even, clusters in ((9, False, 4), (9, True, 4), (7, False, 4), (4, True, 4), (4, True, 4), (9, False, 3), (1, True, 2)):
        points = rng.normal(size=(n, 3))
        mass = np.full(n, 1.0) if even else rng.random(n) + 0.1
        d = np.linalg.norm(points[:, None] - points[None], axis=2)
        cut.append(gromov.quantise(gromov.Space(d, mass / mass.sum()), centroid_linkage(d, clusters)))
    # a cluster without mass
    d = np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0)))
    cut.append(gromov.quantise(gromov.Space(d, np.array([0.0, 0.0, 0.25, 0.25, 0.5])), np.array([1, 1, 2, 2, 3])))
    couples = [(x, y) for x in cut for y in cut]
    want = [gromov.quantised_gw(x, y) for x, y in couples]

    def single(*_):
        raise AssertionError("a pair is taken alone")

    monkeypatch.setattr(gromov, "quantised_gw", single)
    monkeypatch.setattr(gromov, "line_plan", single)
    for room in (pairs.room, lambda n, m: 2):
        dist, converged = gromov.quantised_batch(couples, room)
        assert dist == pytest.approx([w.dist for w in want], abs=1e-7) and converged.tolist() == [w.converged for w in want]
        # where a distance is not the root of a rounding error, it has all its digits
        far = np.array([w.dist > 1e-3 for w in want])
        assert far.sum() > 40 and dist[far] == pytest.approx(np.array([w.dist for w in want])[far], abs=1e-10)
