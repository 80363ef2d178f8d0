"""Optimal transport: exact plans, one-dimensional plans, and entropic scaling."""

from __future__ import annotations

import numpy as np

INF = np.inf


def assign(costs: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest assignments of a batch of square cost matrices (batch, n, n), all in lockstep: shortest augmenting paths, where every step is one
    numpy operation over the batch. Returns the column of each row and the column duals; `start` may hold duals of similar matrices."""
    batch, n, _ = costs.shape
    every = np.arange(batch)
    v = costs.min(axis=1) if start is None else start.copy()
    # rows take their cheapest column if nobody has it yet; duals stay feasible with u as the reduced row minimum
    reduced = costs - v[:, None, :]
    if start is not None:
        # columns that are no row's cheapest come as near as rows allow, so that fewer rows want the same one
        slack = (reduced - reduced.min(axis=2, keepdims=True)).min(axis=1)
        v += slack
        reduced -= slack[:, None, :]
    best = reduced.argmin(axis=2)
    u = np.take_along_axis(reduced, best[:, :, None], axis=2)[:, :, 0]
    column_of, row_of = np.full((batch, n), -1), np.full((batch, n), -1)
    for row in range(n):
        j = best[:, row]
        free = row_of[every, j] < 0
        row_of[every[free], j[free]] = row
        column_of[free, row] = j[free]
    while True:
        todo = np.flatnonzero((column_of < 0).any(axis=1))
        if not len(todo):
            return column_of, v
        root = (column_of[todo] < 0).argmax(axis=1)
        m = len(todo)
        dist, from_row = np.full((m, n), INF), np.zeros((m, n), dtype=np.int64)
        open_ = np.ones((m, n), dtype=bool)
        row, low, sink = root.copy(), np.zeros(m), np.full(m, -1)
        active = np.arange(m)
        while len(active):
            at = todo[active]
            through = low[active, None] + costs[at, row[active]] - u[at, row[active], None] - v[at]
            better = open_[active] & (through < dist[active])
            dist[active] = np.where(better, through, dist[active])
            from_row[active] = np.where(better, row[active, None], from_row[active])
            j = np.where(open_[active], dist[active], INF).argmin(axis=1)
            low[active] = dist[active, j]
            open_[active, j] = False
            owner = row_of[at, j]
            ended = owner < 0
            sink[active[ended]] = j[ended]
            row[active[~ended]] = owner[~ended]
            active = active[~ended]
        # duals of what was scanned, then flip the path
        gain = np.where(open_, 0.0, low[:, None] - dist)
        owners = row_of[todo]
        k, j = np.nonzero(~open_ & (owners >= 0))
        u[todo[k], owners[k, j]] += gain[k, j]
        u[todo, root] += low
        v[todo] -= gain
        j, k = sink, np.arange(m)
        while len(k):
            i = from_row[k, j]
            back = column_of[todo[k], i]
            column_of[todo[k], i] = j
            row_of[todo[k], j] = i
            going = i != root[k]
            k, j = k[going], back[going]


def assign_products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """assign() of the costs -2 x_i y_j of numbers (batch, n) twice: in ascending order they face each other. The dual of each next column grows by
    the mean of what its own and the former row allow. Where numbers repeat, several assignments are cheapest, and assign() picks one."""
    batch, n = x.shape
    of_x, of_y = np.argsort(x, axis=1), np.argsort(y, axis=1)
    x_up, y_up = np.take_along_axis(x, of_x, axis=1), np.take_along_axis(y, of_y, axis=1)
    steps = np.zeros((batch, n))
    np.cumsum((x_up[:, 1:] + x_up[:, :-1]) * (y_up[:, :-1] - y_up[:, 1:]), axis=1, out=steps[:, 1:])
    column_of, v = np.empty((batch, n), dtype=np.int64), np.empty((batch, n))
    np.put_along_axis(column_of, of_x, of_y, axis=1)
    np.put_along_axis(v, of_y, steps, axis=1)
    tied = np.flatnonzero((x_up[:, 1:] == x_up[:, :-1]).any(axis=1) | (y_up[:, 1:] == y_up[:, :-1]).any(axis=1))
    if len(tied):
        column_of[tied], v[tied] = assign(-2.0 * x[tied, :, None] * y[tied, None])
    return column_of, v


def emd(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """An optimal plan between masses a and b: successive shortest paths with potentials on the dense bipartite graph; uniform masses of equal
    number are an assignment. Points without mass are left out."""
    n, m = cost.shape
    if n == m and np.ptp(a) < 1e-12 and np.ptp(b) < 1e-12:
        plan = np.zeros((n, m))
        plan[np.arange(n), assign(cost[None])[0][0]] = a[0]
        return plan
    rows, cols = np.flatnonzero(a > 0), np.flatnonzero(b > 0)
    plan = np.zeros((n, m))
    if not len(rows) or not len(cols):
        return plan
    plan[np.ix_(rows, cols)] = _flow(a[rows] / a.sum(), b[cols] / b.sum(), cost[np.ix_(rows, cols)]) * a.sum()
    return plan


def _flow(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    n, m = cost.shape
    supply, demand, plan = a.copy(), b.copy(), np.zeros((n, m))
    v = cost.min(axis=0)
    u = (cost - v).min(axis=1)
    tiny = 1e-13
    while True:
        sources = np.flatnonzero(supply > tiny)
        if not len(sources) or not (demand > tiny).any():
            return plan
        # Dijkstra from all sources at once; reduced costs are nonnegative, and zero along edges that carry flow
        dist_row, dist_col = np.full(n, INF), np.full(m, INF)
        dist_row[sources] = 0.0
        row_from, col_from = np.full(n, -1), np.full(m, -1)
        done_row, done_col = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
        carried = plan > tiny
        end = -1
        fresh = sources
        while end < 0:
            if len(fresh):
                through = dist_row[fresh, None] + cost[fresh] - u[fresh, None] - v
                pick = through.argmin(axis=0)
                value = through[pick, np.arange(m)]
                better = ~done_col & (value < dist_col)
                dist_col[better], col_from[better] = value[better], fresh[pick[better]]
                done_row[fresh] = True
            j = int(np.where(done_col, INF, dist_col).argmin())
            done_col[j] = True
            if demand[j] > tiny:
                end = j
                break
            fresh = np.flatnonzero(carried[:, j] & ~done_row)
            dist_row[fresh], row_from[fresh] = dist_col[j], j
            if not len(fresh) and done_col.all():
                return plan
        reach = dist_col[end]
        v[done_col] -= reach - dist_col[done_col]
        u[done_row] += reach - dist_row[done_row]
        path, j = [], end
        while True:
            i = int(col_from[j])
            path.append((i, j, 1))
            if row_from[i] < 0:
                break
            j = int(row_from[i])
            path.append((i, j, -1))
        amount = min([supply[i], demand[end], *(plan[i, j] for i, j, sign in path if sign < 0)])
        for i, j, sign in path:
            plan[i, j] += sign * amount
        supply[path[-1][0]] -= amount
        demand[end] -= amount
        plan[plan < tiny] = 0.0


def flow_batch(a: np.ndarray, b: np.ndarray, cost: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Optimal plans (batch, n, m) between positive masses (batch, n) and (batch, m) of equal sums: the shortest paths of emd(), for the whole batch
    in lockstep. Returns plans and column duals; `start` may hold duals of similar costs."""
    batch, n, m = cost.shape
    supply, demand, plan = a.copy(), b.copy(), np.zeros((batch, n, m))
    v = cost.min(axis=1) if start is None else start.copy()
    reduced = cost - v[:, None]
    best, every = reduced.argmin(axis=2), np.arange(batch)
    u = np.take_along_axis(reduced, best[:, :, None], axis=2)[:, :, 0]
    tiny = 1e-13
    # rows give their cheapest column what it takes
    for i in range(n):
        j = best[:, i]
        amount = np.minimum(supply[:, i], demand[every, j])
        plan[every, i, j] = amount
        supply[:, i] -= amount
        demand[every, j] -= amount
    todo = every
    while True:
        todo = todo[(supply[todo] > tiny).any(axis=1) & (demand[todo] > tiny).any(axis=1)]
        if not len(todo):
            return np.where(plan < tiny, 0.0, plan), v
        k = np.arange(len(todo))
        reduced = cost[todo] - u[todo, :, None] - v[todo, None]
        done_row, free, carried = supply[todo] > tiny, demand[todo] > tiny, plan[todo] > tiny
        dist_row, row_from = np.where(done_row, 0.0, INF), np.full((len(todo), n), -1)
        from_source = np.where(done_row[:, :, None], reduced, INF)
        col_from, dist_col = from_source.argmin(axis=1), from_source.min(axis=1)
        done_col, end, active = np.zeros((len(todo), m), dtype=bool), np.full(len(todo), -1), k
        while len(active):
            j = np.where(done_col[active], INF, dist_col[active]).argmin(axis=1)
            done_col[active, j] = True
            ended = free[active, j]
            end[active[ended]] = j[ended]
            active, j = active[~ended], j[~ended]
            # rows that a column's flow leads back to: a few for each problem, one after another
            at, rows = np.nonzero(carried[active, :, j] & ~done_row[active])
            turn = np.arange(len(at)) - np.searchsorted(at, at)
            for t in range(turn.max() + 1 if len(turn) else 0):
                x, i = active[at[turn == t]], rows[turn == t]
                far = dist_col[x, j[at[turn == t]]]
                dist_row[x, i], row_from[x, i], done_row[x, i] = far, j[at[turn == t]], True
                through = far[:, None] + reduced[x, i]
                better = ~done_col[x] & (through < dist_col[x])
                dist_col[x] = np.where(better, through, dist_col[x])
                col_from[x] = np.where(better, i[:, None], col_from[x])
        reach = dist_col[k, end][:, None]
        v[todo] -= np.where(done_col, reach - dist_col, 0.0)
        u[todo] += np.where(done_row, reach - np.where(done_row, dist_row, 0.0), 0.0)
        amount, path, x, j = demand[todo, end], [], k, end
        while len(x):
            i = col_from[x, j]
            back = row_from[x, i]
            path.append((x, i, j, back))
            first = back < 0
            amount[x] = np.minimum(amount[x], np.where(first, supply[todo[x], i], plan[todo[x], i, back]))
            x, j = x[~first], back[~first]
        for x, i, j, back in path:
            first = back < 0
            plan[todo[x], i, j] += amount[x]
            plan[todo[x[~first]], i[~first], back[~first]] -= amount[x[~first]]
            supply[todo[x[first]], i[first]] -= amount[x[first]]
        demand[todo, end] -= amount
        left = plan[todo]
        plan[todo] = np.where(left < tiny, 0.0, left)


def emd_cost(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    return float((emd(a, b, cost) * cost).sum())


def overlap(a: float, b: float, c: float, d: float) -> float:
    """The length that the intervals [a, b] and [c, d] share."""
    return max(0.0, min(b, d) - max(a, c))


def line_plan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The monotone plan between masses a and b of points in order, as (i, j, mass): both cumulative sums cut [0, 1] into pieces."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    cuts = np.union1d(ends_a[:-1], ends_b[:-1])
    cuts = np.r_[0.0, cuts[(cuts > 0) & (cuts < ends_a[-1])], ends_a[-1]]
    mid = (cuts[1:] + cuts[:-1]) / 2
    i = np.minimum(np.searchsorted(ends_a, mid, side="right"), len(a) - 1)
    j = np.minimum(np.searchsorted(ends_b, mid, side="right"), len(b) - 1)
    mass = np.diff(cuts)
    keep = mass > 1e-15
    return i[keep], j[keep], mass[keep]


def step_l2(f: np.ndarray, wf: np.ndarray, g: np.ndarray, wg: np.ndarray) -> float:
    """Squared L2 distance of two step functions on [0, 1] with values f, g on pieces of lengths wf, wg."""
    i, j, mass = line_plan(wf, wg)
    return float((mass * (f[i] - g[j]) ** 2).sum())


def sinkhorn(cost: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float, tol: float = 1e-9, rounds: int = 2000) -> np.ndarray:
    """Entropic plan between masses a and b, in the log domain."""
    with np.errstate(divide="ignore"):
        log_a, log_b = np.log(a), np.log(b)
    f, g = np.zeros(len(a)), np.zeros(len(b))
    for _ in range(rounds):
        f = eps * (log_a - _lse((g - cost) / eps, 1))
        f[~np.isfinite(f)] = -INF
        g = eps * (log_b - _lse((f[:, None] - cost) / eps, 0))
        g[~np.isfinite(g)] = -INF
        plan = np.exp(np.where(np.isfinite(f[:, None] + g), (f[:, None] + g - cost) / eps, -INF))
        if np.abs(plan.sum(axis=1) - a).max() < tol:
            break
    return plan


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def unbalanced_sinkhorn(cost: np.ndarray, a: np.ndarray, b: np.ndarray, rho_a: float, rho_b: float, eps: float, start: tuple[np.ndarray, np.ndarray] | None = None, tol: float = 1e-4, rounds: int = 500) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Minimises <cost, P> + rho_a KL(P 1 | a) + rho_b KL(P' 1 | b) + eps KL(P | a x b), in the log domain. Returns the plan and its
    potentials, with which a similar problem may start."""
    log_a, log_b = np.log(np.maximum(a, 1e-300)), np.log(np.maximum(b, 1e-300))
    f, g = start if start is not None else (np.zeros(len(a)), np.zeros(len(b)))
    damp_a, damp_b = rho_a / (rho_a + eps), rho_b / (rho_b + eps)
    for _ in range(rounds):
        before = f
        f = -damp_a * eps * _lse((g - cost) / eps + log_b, 1)
        g = -damp_b * eps * _lse((f[:, None] - cost) / eps + log_a[:, None], 0)
        if np.abs(f - before).max() < tol * eps:
            break
    return np.exp((f[:, None] + g - cost) / eps + log_a[:, None] + log_b), (f, g)


def unbalanced_sinkhorn_batch(cost: np.ndarray, a: np.ndarray, b: np.ndarray, rho_a: float, rho_b: float, eps: float, start: tuple[np.ndarray, np.ndarray] | None = None, tol: float = 1e-4, rounds: int = 500) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """unbalanced_sinkhorn() of many problems of one size at once; each ends by itself."""
    log_a, log_b = np.log(np.maximum(a, 1e-300)), np.log(np.maximum(b, 1e-300))
    f, g = (x.copy() for x in start) if start is not None else (np.zeros(a.shape), np.zeros(b.shape))
    damp_a, damp_b = rho_a / (rho_a + eps), rho_b / (rho_b + eps)
    active = np.arange(len(cost))
    scaled, of_a, of_b = cost / eps, log_a, log_b
    for _ in range(rounds):
        before = f[active]
        f[active] = -damp_a * eps * _lse((g[active] / eps + of_b)[:, None] - scaled, 2)
        g[active] = -damp_b * eps * _lse((f[active] / eps + of_a)[:, :, None] - scaled, 1)
        going = ~(np.abs(f[active] - before).max(axis=1) < tol * eps)
        if not going.all():
            active = active[going]
            if not len(active):
                break
            scaled, of_a, of_b = scaled[going], of_a[going], of_b[going]
    return np.exp((f[:, :, None] + g[:, None] - cost) / eps + log_a[:, :, None] + log_b[:, None]), (f, g)


def kl(p: np.ndarray, q: np.ndarray) -> float:
    """Generalised Kullback-Leibler divergence, sum p ln(p/q) - p + q."""
    return kl_plain(p, q) - float(p.sum()) + float(q.sum())


def kl_plain(p: np.ndarray, q: np.ndarray) -> float:
    """sum p ln(p/q)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.where(p > 0, p * np.log(p / q), 0.0).sum())
