"""Numerical kernels against brute force and identities."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapespark.functions import clusters, gromov, paths, tails, transport
from shapespark.functions.gromov import Space, uniform

rng = np.random.default_rng(0)


def cloud(n: int, seed: int, dims: int = 3) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return np.linalg.norm(x[:, None] - x[None], axis=2)


def test_assignment_against_all_permutations():
    costs = rng.random((30, 6, 6))
    best = [min(c[range(6), p].sum() for p in map(list, itertools.permutations(range(6)))) for c in costs]
    chosen, duals = transport.assign(costs)
    assert np.allclose([c[range(6), p].sum() for c, p in zip(costs, chosen, strict=True)], best)
    again, _ = transport.assign(costs + 0.1, duals)
    assert np.allclose([c[range(6), p].sum() for c, p in zip(costs, again, strict=True)], best)
    ties, _ = transport.assign(np.zeros((3, 5, 5)))
    assert all(sorted(t) == list(range(5)) for t in ties)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=5), st.lists(st.integers(0, 4), min_size=1, max_size=5), st.integers(0, 1000))
def test_emd_against_assignment_of_units(a, b, seed):
    if not sum(a) or not sum(b):
        return
    cost = np.random.default_rng(seed).random((len(a), len(b)))
    p, q = np.array(a) * sum(b), np.array(b) * sum(a)
    plan = transport.emd(p / p.sum(), q / q.sum(), cost)
    assert np.allclose(plan.sum(axis=1), p / p.sum()) and np.allclose(plan.sum(axis=0), q / q.sum()) and (plan >= 0).all()
    units = np.repeat(np.repeat(cost, p, axis=0), q, axis=1)
    chosen, _ = transport.assign(units[None])
    assert math.isclose((plan * cost).sum(), units[np.arange(len(units)), chosen[0]].mean(), abs_tol=1e-9)


def test_emd_on_a_line_is_monotone():
    x, y, a, b = np.sort(rng.random(7)), np.sort(rng.random(5)), rng.dirichlet(np.ones(7)), rng.dirichlet(np.ones(5))
    i, j, mass = transport.line_plan(a, b)
    cost = (x[:, None] - y) ** 2
    assert math.isclose((mass * cost[i, j]).sum(), transport.emd_cost(a, b, cost), abs_tol=1e-9)
    assert np.allclose(np.bincount(i, mass, 7), a) and np.allclose(np.bincount(j, mass, 5), b)


def test_sinkhorn_tends_to_emd():
    a, b, cost = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(8)), rng.random((6, 8))
    plan = transport.sinkhorn(cost, a, b, 0.005)
    assert np.allclose(plan.sum(axis=0), b) and (plan * cost).sum() - transport.emd_cost(a, b, cost) < 0.01


def test_gw_identities():
    d = cloud(12, 1)
    perm = rng.permutation(12)
    x = Space(d, uniform(12))
    assert gromov.gw(x, x).dist < 1e-7
    for seed in range(4):
        y = Space(cloud(12, seed + 10), uniform(12))
        one, other = gromov.gw(x, y), gromov.gw(y, x)
        assert math.isclose(one.dist, math.sqrt(gromov.squared_cost(x.d, y.d, one.plan)) / 2, rel_tol=1e-9)
        assert np.allclose(one.plan.sum(axis=0), y.mass) and one.converged
        assert gromov.slb(x, y) <= min(one.dist, other.dist) + 1e-12
        batch, chosen, ended = gromov.gw_batch(x.d[None], y.d[None])
        assert math.isclose(batch[0], one.dist, rel_tol=1e-9) and ended[0] and sorted(chosen[0]) == list(range(12))
        q = gromov.quantised_gw(gromov.quantise(x, clusters.centroid_linkage(x.d, 5)), gromov.quantise(y, clusters.centroid_linkage(y.d, 5)))
        assert q.dist >= gromov.slb(x, y) - 1e-9 and np.allclose(q.plan.sum(axis=1)[np.argsort(gromov.quantise(x, clusters.centroid_linkage(x.d, 5)).order)], x.mass)
    assert gromov.quantised_gw(gromov.quantise(x, np.arange(12)), gromov.quantise(Space(d[perm][:, perm], x.mass), np.arange(12))).dist >= 0


def test_fused_and_entropic():
    x, y = Space(cloud(10, 1), uniform(10)), Space(cloud(8, 2), uniform(8))
    plain = gromov.gw(x, y)
    found, quadratic, linear = gromov.fused_gw(x, y, np.zeros((10, 8)), 1.0, start=plain.plan)
    assert found.dist <= (2 * plain.dist) ** 2 + 1e-9 and linear == 0 and math.isclose(quadratic, found.dist)
    cost = rng.random((10, 8))
    only, _, paid = gromov.fused_gw(x, y, cost, 0.0)
    assert math.isclose(paid, transport.emd_cost(x.mass, y.mass, cost), abs_tol=1e-9)
    assert gromov.entropic_gw(x, y, 0.5).dist >= gromov.slb(x, y)
    penalties = gromov.penalty_matrix({(1, 3): 2.0, (4, 4): 1.0}, np.array([1, 3, 4]), np.array([3, 1, 4]))
    assert penalties.tolist() == [[2, 0, 0], [0, 2, 0], [0, 0, 1]]


def test_unbalanced_limits_and_closed_form():
    x, y = Space(cloud(8, 3), uniform(8)), Space(cloud(8, 4), uniform(8))
    close = gromov.unbalanced_gw(x, y, 1e5, 1e5, 0.02, tol=1e-3)
    assert abs(close.plan.sum() - 1) < 1e-3 and close.gw < (2 * gromov.gw(x, y).dist) ** 2 * 1.3
    free = gromov.unbalanced_gw(x, y, 0.1, 0.1, 0.05)
    assert free.plan.sum() < 1 and math.isclose(free.value, free.gw + 0.1 * (free.kl_x + free.kl_y))
    p, q = rng.random(5), rng.random(5)
    assert math.isclose(gromov.kl_squared(p, q), transport.kl(np.outer(p, p), np.outer(q, q)), rel_tol=1e-9)
    cost = 0.7
    rho = gromov.rho_of(cost, 0.8)
    assert math.isclose(gromov.mass_bound(cost, rho, rho), 0.8) and gromov.unbalanced_bound(cost, rho, rho) <= cost


def test_deformation_sums_to_cost():
    x, y = cloud(9, 5), cloud(7, 6)
    plan = transport.emd(uniform(9), uniform(7), rng.random((9, 7)))
    a, b = gromov.deformation(x, y, plan)
    brute = np.einsum("ikjl,ik,jl->ik", (x[:, None, :, None] - y[None, :, None, :]) ** 2, plan, plan)
    assert np.allclose(a, brute.sum(axis=1)) and np.allclose(b, brute.sum(axis=0))


def test_clusters():
    x = np.r_[rng.normal(0, 0.2, (12, 2)), rng.normal(4, 0.2, (12, 2)), rng.normal([0, 6], 0.2, (12, 2))]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for label in (clusters.centroid_linkage(d, 3), clusters.kmeans(x, 3)[1], clusters.louvain((d < 2) & (d > 0)), clusters.louvain((d < 2) & (d > 0), refine=True), clusters.louvain((d < 2) & (d > 0), 0.1, True, True)):
        assert all(len(set(label[k : k + 12])) == 1 for k in (0, 12, 24)) and len(set(label)) == 3
    assert len(set(clusters.centroid_linkage(d, 40))) == 36 and np.allclose(clusters.shares(np.array([0, 0, 1])), [2 / 3, 1 / 3])


def test_paths():
    d = cloud(15, 7, 2)
    edges = np.argwhere(np.triu(paths.neighbours(d, 3)))
    graph = paths.adjacency(15, edges, d[edges[:, 0], edges[:, 1]])
    full = np.full((15, 15), np.inf)
    np.fill_diagonal(full, 0)
    for a, b in edges:
        full[a, b] = full[b, a] = d[a, b]
    for k in range(15):
        full = np.minimum(full, full[:, k, None] + full[None, k])
    assert np.allclose(np.stack([paths.shortest(graph, s)[0] for s in range(15)]), full)
    tree = paths.spanning_tree(d)
    assert len(tree) == 14 and len(set(paths.labels_of(15, np.array(tree)))) == 1
    line = np.abs(np.arange(20)[:, None] - np.arange(20)[None]).astype(float)
    found = paths.isomap(line, 2, 1)[:, 0]
    spread = np.random.default_rng(3).random((300, 1))
    assert np.allclose(np.abs(np.diff(found)), 1) and paths.intrinsic_dimension(np.abs(spread - spread.T), 20) == 1


def test_tails():
    for t, dof, p in ((2.228138852, 10, 0.025), (0.0, 3, 0.5), (-2.228138852, 10, 0.975), (1.959964, 1e7, 0.025)):
        assert tails.t_tail(t, dof) == pytest.approx(p, abs=1e-6)
    assert tails.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6) and tails.beta_ratio(2, 3, 0.4) == pytest.approx(0.5248)
    x, y = np.c_[np.ones(50), rng.random(50)], rng.random((50, 2))
    fit = tails.least_squares(x, y)
    assert np.allclose(x.T @ fit["resid"], 0) and np.allclose(fit["sse"] + fit["ssr"], ((y - y.mean(axis=0)) ** 2).sum(axis=0))
