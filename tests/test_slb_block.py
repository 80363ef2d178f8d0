"""Lower bounds of a block of pairs at once, against one pair at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shapespark.functions import gromov
from shapespark.operators.pairs import pair_index, slb_block, slb_weighted
from shapespark.plans import catalog, views

from .conftest import SF


def test_blocks_are_pairs_one_by_one():
    rng = np.random.default_rng(3)

    def function(n: int, scale: float = 1.0):
        d = np.abs(rng.normal(size=(n, n))) * scale
        mass = rng.random(n) + 0.01
        return gromov.quantile_function(gromov.Space(d + d.T, mass / mass.sum()))

    left = [function(n) for n in (1, 2, 5, 16, 16, 30)] + [function(9, 1e4)]
    right = [function(n) for n in (3, 16, 7)] + [left[3], (left[4][0] * (1 + 1e-9), left[4][1]), left[6]]
    found = slb_block(left, right)
    want = np.array([[gromov.slb_of(x, y) for y in right] for x in left])
    assert np.allclose(found, want, rtol=1e-8, atol=1e-12)
    # alike pairs keep what one pair at a time gives
    assert (found[3, 3], found[4, 4], found[6, 5]) == (want[3, 3], want[4, 4], want[6, 5])


def test_steps_of_pairs_are_not_joined(spark):
    found = catalog.QUERIES["slb_weighted"](spark, SF)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    few = [r.id for r in views.vectors(spark, SF).orderBy("id").limit(40).collect()]
    spaces = views.weighted_spaces(spark, SF).filter(F.col("id").isin(few))
    want = {(r["first"], r["second"]): r.slb for r in slb_weighted(spaces, pairs=pair_index(spaces, group="label")).collect()}
    got = {(r["first"], r["second"]): r.slb for r in found.filter(F.col("first").isin(few) & F.col("second").isin(few)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
