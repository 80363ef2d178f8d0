"""Gromov-Wasserstein distances between metric-measure spaces, and their relatives. A space is a square distance matrix and its masses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import transport
from .transport import assign, assign_products, emd, flow_batch, kl, kl_plain, line_plan

#: The descent ends at the latest after so many steps; then `converged` is false.
MAX_STEPS = 1000


@dataclass
class Space:
    """A metric-measure space with what every comparison needs of it."""

    d: np.ndarray
    mass: np.ndarray
    reach: np.ndarray = field(init=False)
    size: float = field(init=False)

    def __post_init__(self):
        self.reach = self.d @ self.mass
        self.size = float((self.d * self.d) @ self.mass @ self.mass)


@dataclass
class Result:
    dist: float
    plan: np.ndarray
    converged: bool
    steps: int


@dataclass
class Solved:
    """Results of a batch of pairs. plan: (batch, n, m), or the column of each row, (batch, n), where plans are permutations of equal masses."""

    dist: np.ndarray
    plan: np.ndarray
    converged: np.ndarray
    steps: np.ndarray

    def entries(self) -> tuple[list, list, list]:
        """Rows, columns and masses of each plan's entries."""
        if self.plan.ndim == 2:
            batch, n = self.plan.shape
            return [np.arange(n)] * batch, list(self.plan), [np.full(n, 1.0 / n)] * batch
        found = [np.nonzero(p > 0) for p in self.plan]
        return [i for i, _ in found], [j for _, j in found], [p[e] for p, e in zip(self.plan, found, strict=True)]


def uniform(n: int) -> np.ndarray:
    return np.full(n, 1.0 / n)


def squared_cost(a: np.ndarray, b: np.ndarray, plan: np.ndarray) -> float:
    """Sum over all pairs of (a_ij - b_kl)^2 P_ik P_jl, for any plan."""
    p, q = plan.sum(axis=1), plan.sum(axis=0)
    return float((a * a) @ p @ p + (b * b) @ q @ q - 2 * ((a @ plan @ b) * plan).sum())


def gw(x: Space, y: Space, start: np.ndarray | None = None, max_steps: int = MAX_STEPS) -> Result:
    """Descent by full steps to the plan that is best for the linearised cost, from the product coupling (or `start`), as long as the cost
    falls. The distance is half the root of the cost, the plan the one that has it."""
    linear = -2.0 * np.outer(x.reach, y.reach) if start is None else -2.0 * x.d @ start @ y.d
    base = x.size + y.size
    cost, plan = base, np.outer(x.mass, y.mass)
    if start is not None:
        plan, cost = start, base + float((linear * start).sum())
    for step in range(max_steps):
        new = emd(x.mass, y.mass, linear)
        after = -2.0 * x.d @ new @ y.d
        value = base + float((after * new).sum())
        if value >= cost - 1e-12 * base:
            return Result(np.sqrt(max(cost, 0.0)) / 2, plan, True, step)
        cost, plan, linear = value, new, after
    return Result(np.sqrt(max(cost, 0.0)) / 2, plan, False, max_steps)


def gw_batch(a: np.ndarray, b: np.ndarray, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances, plans and ends of descend_batch()."""
    return descend_batch(a, b, max_steps)[:3]


def descend_batch(a: np.ndarray, b: np.ndarray, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gw() of many pairs of spaces of n points with equal masses at once: (batch, n, n) twice. Plans are permutations; returns distances,
    the column of each row, whether the descent ended by itself, and its steps."""
    batch, n, _ = a.shape
    base = (a * a).mean(axis=(1, 2)) + (b * b).mean(axis=(1, 2))
    linear = None
    cost, best = base.copy(), np.tile(np.arange(n), (batch, 1))
    active, duals, ended, steps = np.arange(batch), None, np.zeros(batch, dtype=bool), np.zeros(batch, dtype=np.int64)
    for _ in range(max_steps):
        # the product coupling's costs are products themselves
        chosen, duals = assign_products(a.mean(axis=2), b.mean(axis=2)) if linear is None else assign(linear, duals)
        # -2 A P B for a permutation: columns of A in the order of B's rows
        inverse = np.argsort(chosen, axis=1)
        after = (-2.0 / n * a.transpose(0, 2, 1)[active[:, None], inverse]).transpose(0, 2, 1) @ b[active]
        value = base[active] + np.take_along_axis(after, chosen[:, :, None], axis=2).mean(axis=(1, 2))
        falls = value < cost[active] - 1e-12 * base[active]
        ended[active[~falls]] = True
        cost[active[falls]], best[active[falls]] = value[falls], chosen[falls]
        steps[active[falls]] += 1
        active, linear, duals = active[falls], after[falls], duals[falls]
        if not len(active):
            break
    return np.sqrt(np.maximum(cost, 0.0)) / 2, best, ended, steps


def descend_plans(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gw() of many pairs of spaces of n and m points with any positive masses at once: (batch, n, n), (batch, n), (batch, m, m), (batch, m). Returns
    distances, plans, whether the descent ended by itself, and its steps."""
    size = lambda d, mass: ((d * d) @ mass[:, :, None] * mass[:, :, None]).sum(axis=(1, 2))
    base = size(a, p) + size(b, q)
    linear = -2.0 * (a @ p[:, :, None]) * (b @ q[:, :, None]).transpose(0, 2, 1)
    cost, best = base.copy(), p[:, :, None] * q[:, None, :]
    active, duals, ended, steps = np.arange(len(a)), None, np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64)
    whole = p.sum(axis=1, keepdims=True)
    p, q = p / whole, q / q.sum(axis=1, keepdims=True)
    for _ in range(max_steps):
        new, duals = flow_batch(p[active], q[active], linear, duals)
        new *= whole[active, :, None]
        after = -2.0 * a[active] @ new @ b[active]
        value = base[active] + (after * new).sum(axis=(1, 2))
        falls = value < cost[active] - 1e-12 * base[active]
        ended[active[~falls]] = True
        active, linear, duals = active[falls], after[falls], duals[falls]
        cost[active], best[active] = value[falls], new[falls]
        steps[active] += 1
        if not len(active):
            break
    return np.sqrt(np.maximum(cost, 0.0)) / 2, best, ended, steps


def slb(x: Space, y: Space) -> float:
    """A lower bound of the distance: the L2 distance of the quantile functions of all distances, halved."""
    return slb_of(quantile_function(x), quantile_function(y))


def slb_of(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """slb() from quantile functions."""
    return 0.5 * float(np.sqrt(max(transport.step_l2(*x, *y), 0.0)))


def quantile_function(x: Space) -> tuple[np.ndarray, np.ndarray]:
    """Distances in ascending order, first the diagonal's zero, and the mass of pairs that has each; distances keep their own weights."""
    i, j = np.triu_indices(len(x.mass), 1)
    order = np.argsort(x.d[i, j], kind="stable")
    return np.r_[0.0, x.d[i, j][order]], np.r_[(x.mass**2).sum(), (2 * x.mass[i] * x.mass[j])[order]]


@dataclass
class Quantised:
    """A space cut into clusters: points in the order of cluster and distance to its medoid, cluster ends, and the space of medoids. Each point has its
    cluster, and the part of its cluster's mass, from start to stop, that is its own."""

    space: Space
    order: np.ndarray
    ends: np.ndarray
    medoids: Space
    owner: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    stop: np.ndarray = field(init=False)

    def __post_init__(self):
        sizes = np.diff(self.ends)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        whole = self.medoids.mass[self.owner]
        share = np.divide(self.space.mass, whole, out=np.zeros(len(whole)), where=whole > 0)
        upto = [np.cumsum(share[a:b]) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]
        self.stop = np.concatenate(upto)
        self.start = np.concatenate([np.r_[0.0, u[:-1]] for u in upto])


def quantise(x: Space, labels: np.ndarray) -> Quantised:
    order, ends, centres, masses = [], [0], [], []
    for c in np.unique(labels):
        members = np.flatnonzero(labels == c)
        inner = x.d[np.ix_(members, members)]
        centre = int(inner.sum(axis=0).argmin())
        order.append(members[np.argsort(inner[centre], kind="stable")])
        ends.append(ends[-1] + len(members))
        centres.append(members[centre])
        masses.append(x.mass[members].sum())
    order = np.concatenate(order)
    return Quantised(Space(x.d[np.ix_(order, order)], x.mass[order]), order, np.array(ends), Space(x.d[np.ix_(centres, centres)], np.array(masses)))


def reduced(x: Space, labels: np.ndarray) -> Space:
    """Only the medoids of clusters, with the clusters' masses."""
    return quantise(x, labels).medoids


def quantised_gw(x: Quantised, y: Quantised, coarse: Result | None = None) -> Result:
    """Couple the medoids (or take their `coarse` coupling), spread each coupled pair of clusters by the monotone plan of their points in order, and take the cost of the whole
    plan: an upper bound of the distance of that plan's kind."""
    coarse = coarse or gw(x.medoids, y.medoids)
    plan = np.zeros((len(x.space.mass), len(y.space.mass)))
    for i, j in zip(*np.nonzero(coarse.plan > 1e-15), strict=True):
        rows, cols = slice(x.ends[i], x.ends[i + 1]), slice(y.ends[j], y.ends[j + 1])
        p, q, mass = line_plan(x.space.mass[rows] / x.medoids.mass[i], y.space.mass[cols] / y.medoids.mass[j])
        plan[rows, cols][p, q] += mass * coarse.plan[i, j]
    cost = x.space.size + y.space.size - 2 * float(((x.space.d @ plan @ y.space.d) * plan).sum())
    return Result(np.sqrt(max(cost, 0.0)) / 2, plan, coarse.converged, coarse.steps)


def medoids_batch(couples: list[tuple[Quantised, Quantised]]) -> list[Result]:
    """gw() of the medoids of many pairs, those of equal numbers at once."""
    found, alike = [None] * len(couples), {}
    for k, (x, y) in enumerate(couples):
        p, q = x.medoids.mass, y.medoids.mass
        even = len(p) == len(q) and np.ptp(p) < 1e-12 and np.ptp(q) < 1e-12
        if even or not ((p > 0).all() and (q > 0).all()):
            found[k] = gw(x.medoids, y.medoids)
        else:
            alike.setdefault((len(p), len(q)), []).append(k)
    for places in alike.values():
        sides = [[couples[k][s].medoids for k in places] for s in (0, 1)]
        for k, *one in zip(places, *descend_plans(*[np.stack(v) for side in sides for v in ([m.d for m in side], [m.mass for m in side])]), strict=True):
            found[k] = Result(float(one[0]), one[1], bool(one[2]), int(one[3]))
    return found


def quantised_batch(couples: list[tuple[Quantised, Quantised]], room: Callable[[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of quantised_gw() of many pairs, and whether their medoids' descents ended by themselves; room(n, m) pairs of n and m points at a time. The
    monotone plan between two clusters gives two points what their parts of the clusters' masses have in common."""
    coarse = medoids_batch(couples)
    dist, alike = np.empty(len(couples)), {}
    for k, (x, y) in enumerate(couples):
        alike.setdefault((len(x.owner), len(y.owner), *coarse[k].plan.shape), []).append(k)
    for (n, m, *_), places in alike.items():
        for at in range(0, len(places), room(n, m)):
            part = places[at : at + room(n, m)]
            x, y = ([couples[k][s] for k in part] for s in (0, 1))
            (owner_x, start_x, stop_x), (owner_y, start_y, stop_y) = ([np.stack([getattr(q, f) for q in side]) for f in ("owner", "start", "stop")] for side in (x, y))
            mass = np.stack([coarse[k].plan for k in part])
            mass[mass <= 1e-15] = 0.0
            plan = np.minimum(stop_x[:, :, None], stop_y[:, None]) - np.maximum(start_x[:, :, None], start_y[:, None])
            np.maximum(plan, 0.0, out=plan)
            plan *= mass[np.arange(len(part))[:, None, None], owner_x[:, :, None], owner_y[:, None]]
            cross = np.stack([q.space.d for q in x]) @ plan @ np.stack([q.space.d for q in y])
            size = np.array([p.space.size + q.space.size for p, q in zip(x, y, strict=True)])
            dist[part] = np.sqrt(np.maximum(size - 2 * (cross * plan).sum(axis=(1, 2)), 0.0)) / 2
    return dist, np.array([c.converged for c in coarse], dtype=bool)


def fused_gw(x: Space, y: Space, feature: np.ndarray, alpha: float = 0.5, start: np.ndarray | None = None, max_steps: int = 200, tol: float = 1e-9) -> tuple[Result, float, float]:
    """Minimises alpha * GW cost + (1 - alpha) * <feature, P> by conditional gradients with an exact line search. Result.dist is the minimum;
    the other two numbers are its GW cost and its feature cost."""
    plan = np.outer(x.mass, y.mass) if start is None else start
    base = x.size + y.size

    def linear(p: np.ndarray) -> np.ndarray:
        return x.d @ p @ y.d

    cross = linear(plan)
    for step in range(max_steps):
        gradient = (1 - alpha) * feature - 4 * alpha * cross
        move = emd(x.mass, y.mass, gradient) - plan
        moved = linear(move)
        slope = float((gradient * move).sum())
        curve = -2 * alpha * float((moved * move).sum())
        if slope > -tol * max(base, 1.0):
            break
        t = min(1.0, -slope / (2 * curve)) if curve > 0 else 1.0
        plan, cross = plan + t * move, cross + t * moved
    quadratic, linear_cost = base - 2 * float((cross * plan).sum()), float((feature * plan).sum())
    return Result(alpha * quadratic + (1 - alpha) * linear_cost, plan, step < max_steps - 1, step), quadratic, linear_cost


def fused_batch(a: np.ndarray, b: np.ndarray, feature: np.ndarray, worst_increase: float | None, alpha: float = 0.5, max_steps: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fused_with_budget() of many pairs of spaces of n points with equal masses at once: three times (batch, n, n). Returns minima, their GW costs
    and feature costs, and whether the search ended by itself."""
    batch, n, _ = a.shape
    every, rows = np.arange(batch), np.arange(n)
    base = (a * a).mean(axis=(1, 2)) + (b * b).mean(axis=(1, 2))
    plan = np.full((batch, n, n), 1.0 / (n * n))
    if worst_increase is not None:
        dist, chosen, *_ = descend_batch(a, b)
        plan[:] = 0.0
        plan[every[:, None], rows, chosen] = 1.0 / n
        paid = (feature * plan).sum(axis=(1, 2))
        scale = np.where(paid > 0, worst_increase * (2 * dist) ** 2 / np.where(paid > 0, paid, 1.0), 1.0)
        feature = feature * scale[:, None, None]
    cross, active, duals, ended = a @ plan @ b, every, None, np.zeros(batch, dtype=bool)
    for step in range(max_steps):
        gradient = (1 - alpha) * feature[active] - 4 * alpha * cross[active]
        chosen, duals = assign(gradient, duals)
        move = -plan[active]
        move[np.arange(len(active))[:, None], rows, chosen] += 1.0 / n
        slope = (gradient * move).sum(axis=(1, 2))
        going = ~(slope > -tol * np.maximum(base[active], 1.0))
        ended[active[~going]] = step < max_steps - 1
        active, duals, move, slope = active[going], duals[going], move[going], slope[going]
        if not len(active):
            break
        moved = a[active] @ move @ b[active]
        curve = -2 * alpha * (moved * move).sum(axis=(1, 2))
        t = np.where(curve > 0, np.minimum(1.0, -slope / np.where(curve > 0, 2 * curve, 1.0)), 1.0)[:, None, None]
        plan[active] += t * move
        cross[active] += t * moved
    quadratic, linear = base - 2 * (cross * plan).sum(axis=(1, 2)), (feature * plan).sum(axis=(1, 2))
    return alpha * quadratic + (1 - alpha) * linear, quadratic, linear, ended


def penalty_matrix(penalties: dict[tuple[int, int], float], kinds_x: np.ndarray, kinds_y: np.ndarray) -> np.ndarray:
    """The cost of coupling points of different kinds, in either orientation; a penalty of a kind with itself counts once."""
    out = np.zeros((len(kinds_x), len(kinds_y)))
    for (a, b), value in penalties.items():
        hit = np.logical_and.outer(kinds_x == a, kinds_y == b) | np.logical_and.outer(kinds_x == b, kinds_y == a)
        out[hit] += value
    return out


def fused_with_budget(x: Space, y: Space, feature: np.ndarray, worst_increase: float | None, alpha: float = 0.5) -> tuple[Result, float, float]:
    """fused_gw() started at the plain optimum, with the feature cost scaled so that the plain plan's share of it is worst_increase of the GW
    cost."""
    if worst_increase is None:
        return fused_gw(x, y, feature, alpha)
    plain = gw(x, y)
    cost, paid = (2 * plain.dist) ** 2, float((feature * plain.plan).sum())
    scaled = feature * (worst_increase * cost / paid) if paid > 0 else feature
    return fused_gw(x, y, scaled, alpha, start=plain.plan)


def entropic_gw(x: Space, y: Space, eps: float, rounds: int = 100, tol: float = 1e-9) -> Result:
    """Projected descent: Sinkhorn plans of the linearised cost until the plan stays."""
    plan = np.outer(x.mass, y.mass)
    constant = ((x.d * x.d) @ x.mass)[:, None] + (y.d * y.d) @ y.mass
    for step in range(rounds):
        new = transport.sinkhorn(constant - 2 * x.d @ plan @ y.d, x.mass, y.mass, eps)
        moved = np.abs(new - plan).max()
        plan = new
        if moved < tol:
            break
    return Result(np.sqrt(max(squared_cost(x.d, y.d, plan), 0.0)) / 2, plan, moved < tol, step)


# Unbalanced: marginals may differ from the masses, at a price.


@dataclass
class Unbalanced:
    """GW cost of the plan, divergences of its squared marginals and of its square, the total with and without the entropy term."""

    gw: float
    kl_x: float
    kl_y: float
    kl_plan: float
    total: float
    value: float
    eps: float
    plan: np.ndarray


def kl_squared(p: np.ndarray, q: np.ndarray) -> float:
    """Divergence of p x p from q x q, from sums over p and q alone."""
    m, n = float(p.sum()), float(q.sum())
    return 2 * m * kl_plain(p, q) - m * m + n * n


def _parts(x: Space, y: Space, plan: np.ndarray) -> tuple[float, float, float, float]:
    return squared_cost(x.d, y.d, plan), kl_squared(plan.sum(axis=1), x.mass), kl_squared(plan.sum(axis=0), y.mass), kl_squared(plan, np.outer(x.mass, y.mass))


def unbalanced_gw(x: Space, y: Space, rho_x: float, rho_y: float, eps: float, tol: float = 0.4, tol_scaling: float = 1e-4, rounds: int = 100, retries: int = 50, growth: float = 1.1) -> Unbalanced:
    """Alternates: the local linear problem around the plan is solved by unbalanced scaling, and a backtracking line search (halving, with half
    of the expected decrease) moves the plan towards its solution. Ends when no entry changes by more than the factor 1 + tol. A result that
    isn't finite is tried again with eps larger by `growth`."""
    for _ in range(retries):
        found = _unbalanced(x, y, rho_x, rho_y, eps, tol, tol_scaling, rounds)
        if np.isfinite(found.total):
            return found
        eps *= growth
    return found


def _unbalanced(x: Space, y: Space, rho_x: float, rho_y: float, eps: float, tol: float, tol_scaling: float, rounds: int) -> Unbalanced:
    product = np.outer(x.mass, y.mass)

    def objective(plan: np.ndarray) -> float:
        g, kx, ky, kp = _parts(x, y, plan)
        return g + rho_x * kx + rho_y * ky + eps * kp

    def local(plan: np.ndarray) -> np.ndarray:
        p, q = plan.sum(axis=1), plan.sum(axis=0)
        cost = ((x.d * x.d) @ p)[:, None] + (y.d * y.d) @ q - 2 * x.d @ plan @ y.d
        return cost + rho_x * kl_plain(p, x.mass) + rho_y * kl_plain(q, y.mass) + eps * kl_plain(plan, product)

    def towards(plan: np.ndarray, start) -> tuple[np.ndarray, tuple]:
        mass = plan.sum()
        new, potentials = transport.unbalanced_sinkhorn(local(plan) / mass, x.mass, y.mass, rho_x, rho_y, eps, start, tol_scaling)
        total = new.sum()
        return (new * np.sqrt(mass / total) if total > 0 else new * 0), potentials

    with np.errstate(all="ignore"):
        plan, potentials = towards(product, None)
        loss = objective(plan)
        for _ in range(rounds):
            if not (plan > 0).any() or not np.isfinite(loss):
                break
            goal, potentials = towards(plan, potentials)
            move = goal - plan
            p, q = plan.sum(axis=1), plan.sum(axis=0)
            logs = lambda v, w: np.log(np.maximum(v, 1e-300) / w)
            mass = plan.sum()
            # gradient of the objective: twice the local cost, and what the logarithms' own changes add, which cancels but for mass terms
            gradient = 2 * (local(plan) + mass * (rho_x * logs(p, x.mass)[:, None] + rho_y * logs(q, y.mass) + eps * logs(plan, product)))
            slope = float((gradient * move).sum())
            t = 1.0
            while t > 1e-6 and not (value := objective(plan + t * move)) <= loss + 0.5 * t * min(slope, 0.0):
                t /= 2
            if t <= 1e-6:
                break
            new = plan + t * move
            still = (new * (1 + tol) >= plan).all() and (plan * (1 + tol) >= new).all()
            plan, loss = new, value
            if still:
                break
        g, kx, ky, kp = _parts(x, y, plan)
    return Unbalanced(g, kx, ky, kp, g + rho_x * kx + rho_y * ky + eps * kp, g + rho_x * kx + rho_y * ky, eps, plan)


def unbalanced_batch(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, rho_x: float, rho_y: float, eps: float, tol: float = 0.4, tol_scaling: float = 1e-4, rounds: int = 100) -> list[Unbalanced]:
    """unbalanced_gw() of many pairs of spaces of n and m points at once: (batch, n, n), (batch, n), (batch, m, m), (batch, m). Each pair takes its own steps;
    those without a finite result are tried again alone."""
    product, a2, b2 = p[:, :, None] * q[:, None], a * a, b * b

    def plain(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.where(v > 0, v * np.log(v / w), 0.0).reshape(len(v), -1).sum(axis=1)

    def squared(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        m, n = (x.reshape(len(x), -1).sum(axis=1) for x in (v, w))
        return 2 * m * plain(v, w) - m * m + n * n

    def of(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (matrix @ v[:, :, None])[:, :, 0]

    def parts(plan: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        u, v = plan.sum(axis=2), plan.sum(axis=1)
        cost = (of(a2[k], u) * u).sum(axis=1) + (of(b2[k], v) * v).sum(axis=1) - 2 * ((a[k] @ plan @ b[k]) * plan).sum(axis=(1, 2))
        return cost, squared(u, p[k]), squared(v, q[k]), squared(plan, product[k])

    def objective(plan: np.ndarray, k: np.ndarray) -> np.ndarray:
        g, kx, ky, kp = parts(plan, k)
        return g + rho_x * kx + rho_y * ky + eps * kp

    def local(plan: np.ndarray, k: np.ndarray) -> np.ndarray:
        u, v = plan.sum(axis=2), plan.sum(axis=1)
        cost = of(a2[k], u)[:, :, None] + of(b2[k], v)[:, None] - 2 * a[k] @ plan @ b[k]
        return cost + (rho_x * plain(u, p[k]) + rho_y * plain(v, q[k]) + eps * plain(plan, product[k]))[:, None, None]

    def towards(plan: np.ndarray, cost: np.ndarray, k: np.ndarray, start) -> tuple[np.ndarray, tuple]:
        mass = plan.sum(axis=(1, 2))
        new, potentials = transport.unbalanced_sinkhorn_batch(cost / mass[:, None, None], p[k], q[k], rho_x, rho_y, eps, start, tol_scaling)
        total = new.sum(axis=(1, 2))
        return new * np.where(total > 0, np.sqrt(mass / total), 0.0)[:, None, None], potentials

    every = np.arange(len(a))
    with np.errstate(all="ignore"):
        plan, (f, g) = towards(product, local(product, every), every, None)
        loss, active = objective(plan, every), every
        for _ in range(rounds):
            active = active[(plan[active] > 0).any(axis=(1, 2)) & np.isfinite(loss[active])]
            if not len(active):
                break
            now = plan[active]
            cost = local(now, active)
            goal, (f[active], g[active]) = towards(now, cost, active, (f[active], g[active]))
            move = goal - now
            logs = lambda v, w: np.log(np.maximum(v, 1e-300) / w)
            mass = now.sum(axis=(1, 2))[:, None, None]
            gradient = 2 * (cost + mass * (rho_x * logs(now.sum(axis=2), p[active])[:, :, None] + rho_y * logs(now.sum(axis=1), q[active])[:, None] + eps * logs(now, product[active])))
            slope = np.minimum((gradient * move).sum(axis=(1, 2)), 0.0)
            t, value, short = np.ones(len(active)), np.full(len(active), np.nan), np.arange(len(active))
            while len(short):
                value[short] = objective(now[short] + t[short, None, None] * move[short], active[short])
                short = short[~(value[short] <= loss[active[short]] + 0.5 * t[short] * slope[short])]
                t[short] /= 2
                short = short[t[short] > 1e-6]
            moved = t > 1e-6
            active, now = active[moved], now[moved]
            new = now + t[moved, None, None] * move[moved]
            still = (new * (1 + tol) >= now).all(axis=(1, 2)) & (now * (1 + tol) >= new).all(axis=(1, 2))
            plan[active], loss[active] = new, value[moved]
            active = active[~still]
        gw_cost, kx, ky, kp = parts(plan, every)
        value = gw_cost + rho_x * kx + rho_y * ky
        total = value + eps * kp
    return [
        Unbalanced(*(float(c[k]) for c in (gw_cost, kx, ky, kp, total, value)), eps, plan[k]) if np.isfinite(total[k]) else unbalanced_gw(Space(a[k], p[k]), Space(b[k], q[k]), rho_x, rho_y, eps, tol, tol_scaling, rounds)
        for k in every
    ]


def rho_of(cost: float, mass_kept: float) -> float:
    """The price at which a pair of this GW cost keeps at least such a share of its mass."""
    return -cost / (4 * np.log(mass_kept))


def unbalanced_bound(cost: float, rho_x: float, rho_y: float) -> float:
    return (rho_x + rho_y) * (1 - np.exp(-cost / (rho_x + rho_y)))


def mass_bound(cost: float, rho_x: float, rho_y: float) -> float:
    return float(np.exp(-cost / (2 * (rho_x + rho_y))))


def fused_unbalanced_gw(x: Space, y: Space, feature: np.ndarray, alpha: float, rho: float, eps: float, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Unbalanced scaling around the plan with alpha times the GW part and 1 - alpha times the feature part of the local cost."""
    plan, potentials = np.outer(x.mass, y.mass), None
    for _ in range(rounds):
        p, q = plan.sum(axis=1), plan.sum(axis=0)
        mass = max(plan.sum(), 1e-300)
        cost = alpha * (((x.d * x.d) @ p)[:, None] + (y.d * y.d) @ q - 2 * x.d @ plan @ y.d) / mass + (1 - alpha) * feature / 2
        new, potentials = transport.unbalanced_sinkhorn(cost, x.mass, y.mass, rho, rho, eps, potentials)
        new *= np.sqrt(mass / max(new.sum(), 1e-300))
        if np.abs(new - plan).max() < 1e-9:
            break
        plan = new
    value = alpha * squared_cost(x.d, y.d, plan) + (1 - alpha) * float((feature * plan).sum()) + rho * (kl(plan.sum(axis=1), x.mass) + kl(plan.sum(axis=0), y.mass))
    return plan, value


def deformation(x: np.ndarray, y: np.ndarray, plan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each point of either space adds to the plan's GW cost."""
    p, q = plan.sum(axis=1), plan.sum(axis=0)
    cross = (x @ plan @ y) * plan
    return p * ((x * x) @ p) + plan @ ((y * y) @ q) - 2 * cross.sum(axis=1), plan.T @ ((x * x) @ p) + q * ((y * y) @ q) - 2 * cross.sum(axis=0)


def deformation_batch(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """deformation() of many pairs of spaces of n points with equal masses at once, (batch, n, n) twice, whose plans are permutations: points that
    face each other add the same."""
    batch, n, _ = x.shape
    facing = y[np.arange(batch)[:, None, None], columns[:, :, None], columns[:, None, :]]
    of_x = ((x - facing) ** 2).sum(axis=2) / (n * n)
    of_y = np.empty_like(of_x)
    np.put_along_axis(of_y, columns, of_x, axis=1)
    return of_x, of_y
