"""Distances of pairs of spaces. A space is a row (id, n, d, mass): a condensed matrix and the masses of its points.

Pairs are planned by blocks: every space belongs to a block by the hash of its id, and each pair of blocks is one group, which meets in one
task of bounded size (at most two blocks). A space is sent once for each block, not once for each pair, and no table is broadcast. Blocks of
many spaces keep tasks alike: none owns a hot key. Where a kernel writes its pairs, blocks grow with the table, so that a space isn't sent more
often, and the task cuts them into the small ones that the kernel takes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gromov
from ..functions.gromov import Space
from ..storage import materialise, small

#: Spaces of one block, about.
BLOCK = 64
#: Spaces of the smallest blocks, about.
FEW_ROWS = 8
#: Cells of one distribution, on average, from which on distances of distributions are looked up.
COPIES = 4
#: Points of one block where its spaces are small.
SOLVED_POINTS = 4096
#: Tasks that costly pairs of blocks are dealt to at most.
MOST_TASKS = 4096
#: Times that a row is sent, unless all cores need more blocks or one block would have more than so many bytes of numbers.
MOST_SENT, HELD_BYTES = 20, 32 << 20


def room(n: int, m: int) -> int:
    """Pairs of n and m points that a batch kernel takes at a time, where its steps cost more than its numbers: their matrices have some 2 MB."""
    return max(1, min(1024, (1 << 18) // (n * m)))


def square(d: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n, 1)] = d
    return out + out.T


def pair_rows(rows: DataFrame, carried: list[str], key: str = "id", group: str | None = None) -> DataFrame:
    """All pairs first < second (of one group) with the carried columns of both, a_... and b_.... Rows are dealt to blocks of about a thousand, and
    pairs of blocks are an equi-join: a row is sent once for each block, not once for each pair, and a task meets two blocks at a time."""
    g = F.col(group) if group else F.lit(0)
    most = rows.groupBy(g.alias("g")).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, math.ceil(most / (BLOCK * 16)))
    dealt = rows.select(F.col(key).alias("id"), g.alias("g"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[F.col(c) for c in carried if c != key]).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = dealt.select(F.col("id").alias("first"), "g", F.col("block").alias("p"), F.col("other").alias("q"), *[F.col(c).alias(f"a_{c}") for c in carried if c != key])
    right = dealt.select(F.col("id").alias("second"), "g", F.col("other").alias("p"), F.col("block").alias("q"), *[F.col(c).alias(f"b_{c}") for c in carried if c != key])
    return left.join(right, ["g", "p", "q"]).filter("first < second").drop("g", "p", "q")


def pair_index(rows: DataFrame, key: str = "id", group: str | None = None) -> DataFrame:
    """All pairs first < second of ids (of one group)."""
    return pair_rows(rows, [], key, group)


def block_count(rows: int, block: int, numbers: int | None, enough: int) -> int:
    """Blocks that so many rows are dealt to, and so how often each row is sent; see by_blocks()."""
    fine = max(1, math.ceil(rows / block), min(enough, rows // FEW_ROWS))
    return fine if numbers is None else min(fine, max(MOST_SENT, enough, math.ceil(rows * 8 * numbers / HELD_BYTES)))


def by_blocks(spaces: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame], schema: str, targets: DataFrame | None = None, block: int = BLOCK, group: str | None = None, costly: bool = False, numbers: str | None = None) -> DataFrame:
    """kernel(block a, block b) for all pairs of blocks; b is None for the pairs within a block. With targets, a is a block of spaces and b one of
    targets. With a group column only spaces of one group are paired. Blocks are dealt by a hash, about `block` rows each; fewer where there would
    otherwise be too few pairs of blocks for all cores, but FEW_ROWS at least. costly: a pair of blocks takes long for its few bytes, so that tasks are
    not joined by size. numbers: SQL of how many numbers a row holds; then no row is sent to more than MOST_SENT blocks if a task can hold larger ones, and the
    kernel gets them in parts of about `block` rows, whose results leave the task one after another."""
    enough = math.ceil(math.sqrt(6 * spaces.sparkSession.sparkContext.defaultParallelism))

    def blocked(df: DataFrame, side: int) -> tuple[DataFrame, int]:
        df = df.withColumn("g", F.col(group) if group else F.lit(0))
        counted = df.groupBy("g").agg(F.count("*").alias("rows"), F.max(F.expr(numbers or "0")).alias("numbers"))
        most = counted.agg(F.max("rows").alias("rows"), F.max("numbers").alias("numbers")).first()
        count = block_count(most.rows or 0, block, None if numbers is None else most.numbers or 0, enough)
        return df.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"), "side": F.lit(side)}), count

    a, n = blocked(spaces, 0)
    if targets is None:
        # block p meets itself once, and each q > p
        first = a.withColumn("q", F.explode(F.sequence(F.col("block"), F.lit(n - 1)))).withColumn("p", F.col("block"))
        second = a.withColumn("side", F.lit(1)).filter("block > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).withColumn("q", F.col("block"))
        both = first.unionByName(second)
    else:
        b, m = blocked(targets, 1)
        both = a.withColumn("p", F.col("block")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).unionByName(b.withColumn("q", F.col("block")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))

    if costly:
        both = both.repartition(min(MOST_TASKS, 2 * (n * (n + 1) // 2 if targets is None else n * m)), "g", "p", "q")
    among_themselves, cut = targets is None, numbers is not None

    def parts(rows: pd.DataFrame) -> list[pd.DataFrame]:
        # a block may have some rows more than the mean
        n = math.ceil(len(rows) / (block + block // 4)) if cut else 1
        return [rows.iloc[len(rows) * k // n : len(rows) * (k + 1) // n] for k in range(n)] if n > 1 else [rows]

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        if among_themselves and key[1] == key[2]:
            found = parts(left)
            for k, x in enumerate(found):
                yield kernel(x, None)
                for y in found[k + 1 :]:
                    yield kernel(x, y)
        else:
            other = parts(right)
            for x in parts(left):
                for y in other:
                    yield kernel(x, y)

    return both.drop("block").groupBy("g", "p", "q").applyInPandas(run, schema)


#: The numbers of a row of spaces.
NUMBERS = "size(d) + size(mass)"


def solver_block(spaces: DataFrame) -> int:
    """Spaces of one block of a solver: small spaces of equal masses are solved so quickly that sending them would cost more, others keep to BLOCK."""
    found = spaces.agg(F.max("n").alias("n"), F.max(F.array_max("mass") - F.array_min("mass")).alias("uneven")).first()
    return BLOCK if (found.uneven or 0.0) >= 1e-12 else max(BLOCK, min(WIDE_BLOCK, SOLVED_POINTS // (found.n or 1)))


def couples(a: pd.DataFrame, b: pd.DataFrame | None) -> list[tuple[int, int]]:
    """Row numbers of the pairs of a (and b)."""
    return [(i, j) for i in range(len(a)) for j in range(i + 1, len(a))] if b is None else [(i, j) for i in range(len(a)) for j in range(len(b))]


def spaces_of(rows: pd.DataFrame) -> list[Space]:
    return [Space(square(np.asarray(d, float), n), np.asarray(m, float)) for d, n, m in zip(rows.d, rows.n, rows.mass, strict=True)]


def _named(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows (first, second, ...) with names in order; flagged so that callers can transpose what belongs to the points."""
    return pd.DataFrame(rows, columns=columns)


GW_SCHEMA = "first string, second string, dist double, method string, converged boolean, n_iter int"
PLAN_SCHEMA = GW_SCHEMA + ", i array<int>, j array<int>, mass array<double>"


def solved_pairs(a: pd.DataFrame, b: pd.DataFrame | None) -> Iterator[tuple[np.ndarray, np.ndarray, gromov.Solved]]:
    """(first, second, solutions) of all pairs of a (and b), a batch at a time. first and second are rows of a, then b, first's id the smaller."""
    rows = a if b is None else pd.concat([a, b])
    ids, spaces = rows.id.to_numpy(), spaces_of(rows)
    i, j = np.triu_indices(len(a), 1) if b is None else (np.repeat(np.arange(len(a)), len(b)), len(a) + np.tile(np.arange(len(b)), len(a)))
    if not len(i):
        return
    turned = ids[i] > ids[j]
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    # spaces of one kind: of so many points, with masses that are equal, or positive at least
    kinds: dict[tuple, list[int]] = {}
    for k, x in enumerate(spaces):
        kinds.setdefault((len(x.mass), bool(np.ptp(x.mass) < 1e-12), bool((x.mass > 0).all())), []).append(k)
    kind, place = np.empty(len(spaces), np.int64), np.empty(len(spaces), np.int64)
    for k, members in enumerate(kinds.values()):
        kind[members], place[members] = k, np.arange(len(members))
    d, mass = ([np.stack([f(spaces[k]) for k in members]) for members in kinds.values()] for f in (lambda x: x.d, lambda x: x.mass))
    for p, (n, even, positive) in enumerate(kinds):
        for q, (m, other_even, other_positive) in enumerate(kinds):
            met = np.flatnonzero((kind[i] == p) & (kind[j] == q))
            permuted = n == m and even and other_even
            # descents of most pairs end soon, so that larger batches have enough left
            most = max(1, min(4096, (1 << 20) // (n * m))) if permuted else room(n, m)
            for at in range(0, len(met), most):
                u, v = i[met[at : at + most]], j[met[at : at + most]]
                x, y = place[u], place[v]
                if permuted:
                    yield u, v, gromov.Solved(*gromov.descend_batch(d[p][x], d[q][y]))
                elif positive and other_positive:
                    yield u, v, gromov.Solved(*gromov.descend_plans(d[p][x], mass[p][x], d[q][y], mass[q][y]))
                else:
                    found = [gromov.gw(spaces[s], spaces[t]) for s, t in zip(u, v, strict=True)]
                    yield u, v, gromov.Solved(*[np.array(c) for c in zip(*[(f.dist, f.plan, f.converged, f.steps) for f in found], strict=True)])


def gw_kernel(a: pd.DataFrame, b: pd.DataFrame | None, plans: bool = False) -> pd.DataFrame:
    ids = (a if b is None else pd.concat([a, b])).id.to_numpy()
    out = []
    for u, v, found in solved_pairs(a, b):
        rows = {"first": ids[u], "second": ids[v], "dist": found.dist, "method": "GW", "converged": found.converged, "n_iter": found.steps}
        if plans:
            rows |= dict(zip(("i", "j", "mass"), found.entries(), strict=True))
        out.append(pd.DataFrame(rows))
    return pd.concat(out) if out else _named([], [c.split()[0] for c in (PLAN_SCHEMA if plans else GW_SCHEMA).split(", ")])


def gw_pairwise(spaces: DataFrame, plans: bool = False, group: str | None = None) -> DataFrame:
    """Gromov-Wasserstein distances of all pairs (of one group). With plans also i, j and mass of each plan's entries; i are points of `first`."""
    spaces = spaces.select("id", "n", "d", "mass", *([group] if group else []))
    return by_blocks(spaces, lambda a, b: gw_kernel(a, b, plans), PLAN_SCHEMA if plans else GW_SCHEMA, block=solver_block(spaces), group=group, costly=True, numbers=NUMBERS)


def gw_query_target(queries: DataFrame, targets: DataFrame, plans: bool = False) -> DataFrame:
    """The same for queries against targets; pairs of a name with itself are left out."""
    return by_blocks(queries, lambda a, b: gw_kernel(a, b, plans), PLAN_SCHEMA if plans else GW_SCHEMA, targets, costly=True, numbers=NUMBERS).filter("first <> second")


def couplings(found: DataFrame) -> DataFrame:
    """(first, second, i, j, mass) of plans."""
    return found.select("first", "second", F.explode(F.arrays_zip("i", "j", "mass")).alias("e")).select("first", "second", "e.*")


def coupling_sizes(found: DataFrame) -> DataFrame:
    """(first, second, n, mass): the number of couplings() of each pair and their mass, which no shuffle is needed for, as a plan is one row."""
    return found.filter(F.size("i") > 0).select("first", "second", F.size("i").cast("long").alias("n"), F.aggregate("mass", F.lit(0.0), lambda s, m: s + m).alias("mass"))


def slb_block(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """gromov.slb_of() for each quantile function of left and of right. The product of two step functions has the integral sum_k (f_k - f_(k+1)) G(t_k)
    with f's ends t_k and G, the integral of the other, which is linear between its own ends: one interpolation at the ends of all of left. Pairs
    so alike that the difference of squares and product would lose digits are taken step by step."""
    ends = np.concatenate([np.cumsum(w) for _, w in left])
    drops = np.concatenate([np.r_[f[:-1] - f[1:], f[-1]] for f, _ in left])
    starts = np.r_[0, np.cumsum([len(w) for _, w in left])[:-1]]
    own, other = (np.array([(w * f * f).sum() for f, w in side]) for side in (left, right))
    slb = np.empty((len(left), len(right)))
    for j, (g, w) in enumerate(right):
        cross = np.add.reduceat(drops * np.interp(ends, np.r_[0.0, np.cumsum(w)], np.r_[0.0, np.cumsum(w * g)]), starts)
        size = own + other[j]
        gap = size - 2.0 * cross
        slb[:, j] = 0.5 * np.sqrt(np.maximum(gap, 0.0))
        for i in np.flatnonzero(gap <= 1e-7 * size):
            slb[i, j] = gromov.slb_of(left[i], right[j])
    return slb


def slb_pairwise(spaces: DataFrame, group: str | None = None) -> DataFrame:
    """Lower bounds of all pairs; distances keep the weights of their points."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        other = a if b is None else b
        if not len(a) or not len(other):
            return _named([], ["first", "second", "slb"])
        left = [gromov.quantile_function(s) for s in spaces_of(a)]
        right = left if b is None else [gromov.quantile_function(s) for s in spaces_of(other)]
        slb, x, y = slb_block(left, right), a.id.to_numpy(), other.id.to_numpy()
        i, j = np.triu_indices(len(x), 1) if b is None else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
        return pd.DataFrame({"first": np.minimum(x[i], y[j]), "second": np.maximum(x[i], y[j]), "slb": slb[i, j]})

    return by_blocks(spaces, kernel, "first string, second string, slb double", block=2 * WIDE_BLOCK, group=group, numbers=NUMBERS)


#: Spaces of one block where a pair costs little.
WIDE_BLOCK = 256


def slb_uniform(icdm: DataFrame, group: str | None = None) -> DataFrame:
    """Lower bounds of all pairs (of one group) of spaces with equal masses. Between spaces of one size the diagonal's share is the same and
    cancels, and the k-th smallest distances face each other; other pairs take the quantile functions."""
    ranked = icdm.select(F.col("cell_id").alias("id"), "n", F.array_sort("d").alias("d"), *([group] if group else []))

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        # in the order of names, which files of distances compress better by
        a = a.sort_values("id")
        other = a if b is None else b.sort_values("id")
        names, sizes = other.id.to_numpy(), other.n.to_numpy()
        stacked = {n: np.stack(other.d[sizes == n].to_list()) for n in set(sizes.tolist())}
        out = []
        for i, (name, n, d) in enumerate(zip(a.id, a.n, a.d, strict=True)):
            slb = np.empty(len(names))
            for m, rows in stacked.items():
                if m == n:
                    slb[sizes == m] = 0.5 * np.sqrt(2.0 * ((rows - d) ** 2).sum(axis=1) / (n * n))
                else:
                    slb[sizes == m] = [gromov.slb_of(_even_steps(d, n), _even_steps(r, m)) for r in rows]
            left = slice(i + 1, None) if b is None else slice(None)
            out.append(pd.DataFrame({"first": np.minimum(names[left], name), "second": np.maximum(names[left], name), "slb": slb[left]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["first", "second", "slb"])

    return by_blocks(ranked, kernel, "first string, second string, slb double", block=4 * WIDE_BLOCK, group=group, numbers="size(d)")


def _even_steps(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The quantile function of sorted distances between n points of equal mass: the diagonal's zero first."""
    return np.r_[0.0, d], np.r_[1.0 / n, np.full(len(d), 2.0 / (n * n))]


#: Spaces of one block where a block of pairs becomes a row for each space, and of the part of it that meets another block at a time. A space is
#: sent once for each block, so that larger blocks need less disk.
SUMMED_BLOCK, PART = 4096, 512


def ranked(icdm: DataFrame) -> DataFrame:
    """(id, n, d) with sorted distances, as near_matrix() takes them."""
    return icdm.select(F.col("cell_id").alias("id"), "n", F.array_sort("d").alias("d"))


def near_matrix(a: pd.DataFrame, b: pd.DataFrame, below: float) -> np.ndarray:
    """Whether slb_uniform() is less than `below`, for each row of a and of b with sorted distances. A matrix product decides, except where it is so
    close that its error could: those pairs take the differences themselves."""
    near = np.zeros((len(a), len(b)), bool)
    sizes_a, sizes_b = a.n.to_numpy(), b.n.to_numpy()
    for n in set(sizes_a.tolist()):
        i = np.flatnonzero(sizes_a == n)
        x = np.stack(a.d.iloc[i].to_list())
        for m in set(sizes_b.tolist()):
            j = np.flatnonzero(sizes_b == m)
            y = np.stack(b.d.iloc[j].to_list())
            if m != n:
                near[np.ix_(i, j)] = [[gromov.slb_of(_even_steps(p, n), _even_steps(q, m)) < below for q in y] for p in x]
                continue
            most = 2.0 * below * abs(below) * n * n
            for at in range(0, len(x), PART):
                part = x[at : at + PART]
                size = (part * part).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
                gap = size - 2.0 * (part @ y.T)
                found = gap < most
                u, v = np.nonzero(np.abs(gap - most) <= 1e-9 * size)
                found[u, v] = 0.5 * np.sqrt(2.0 * ((part[u] - y[v]) ** 2).sum(axis=1) / (n * n)) < below
                near[np.ix_(i[at : at + PART], j)] = found
    return near


def near_product(near: np.ndarray, values: np.ndarray) -> np.ndarray:
    """near @ values, a part of the rows at a time, as the matrix of numbers is eight times as large."""
    return np.concatenate([near[at : at + PART].astype(float) @ values for at in range(0, len(near), PART)])


def over_near(spaces: DataFrame, below: float, kernel: Callable[[pd.DataFrame, pd.DataFrame | None, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(block a, block b or None, near_matrix) for all pairs of blocks of ranked() spaces; no pair is written. Within a block nothing is near
    itself."""

    def run(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        if not len(a) or b is not None and not len(b):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        near = near_matrix(a, a if b is None else b, below)
        if b is None:
            np.fill_diagonal(near, False)
        return kernel(a, b, near)

    return by_blocks(spaces, run, schema, block=SUMMED_BLOCK)


def near_sums(spaces: DataFrame, below: float, length: int) -> DataFrame:
    """(id, near, sums): how many others are near, and the sums of their arrays f, of so many values; spaces as ranked(), with f."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None, near: np.ndarray) -> pd.DataFrame:
        values = lambda rows: np.array(rows.f.to_list(), float).reshape(len(rows), length)
        out = [pd.DataFrame({"id": a.id.to_numpy(), "near": near.sum(axis=1), "sums": near_product(near, values(a if b is None else b)).tolist()})]
        if b is not None:
            out.append(pd.DataFrame({"id": b.id.to_numpy(), "near": near.sum(axis=0), "sums": near_product(near.T, values(a)).tolist()}))
        return pd.concat(out)

    found = over_near(spaces, below, kernel, "id string, near long, sums array<double>")
    sums = F.array(*[F.sum(F.element_at("sums", k + 1)) for k in range(length)]).cast("array<double>")
    return found.groupBy("id").agg(F.sum("near").alias("near"), sums.alias("sums"))


def half_up(values: np.ndarray, places: int) -> np.ndarray:
    """As round() in SQL: the decimal digits of a value decide, so halves are told from their neighbours by those."""
    scaled = values * 10.0**places
    out = np.floor(scaled + 0.5) / 10.0**places
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


#: Pairs whose distances are taken at a time.
EXACT = 1 << 15


def nearest_of(a: pd.DataFrame, b: pd.DataFrame, k: int, places: int, itself: bool) -> pd.DataFrame:
    """(first, second, dist): for each row of a its k nearest of b by slb_uniform(), rounded, then by name; both as ranked(). itself: a and b are the
    same rows, and none is near itself. A matrix product leaves those that may be among the nearest, whatever its error and the rounding, and they
    take the differences themselves."""
    names_a, names_b, sizes_a, sizes_b = a.id.to_numpy(), b.id.to_numpy(), a.n.to_numpy(), b.n.to_numpy()
    rank = np.empty(len(b), np.int64)
    rank[np.argsort(names_b, kind="stable")] = np.arange(len(b))
    far = {m: (np.flatnonzero(sizes_b == m), np.stack(b.d[sizes_b == m].to_list())) for m in set(sizes_b.tolist())}
    out = []
    for n in set(sizes_a.tolist()):
        of_n = np.flatnonzero(sizes_a == n)
        x_all = np.stack(a.d.iloc[of_n].to_list())
        for at in range(0, len(of_n), PART):
            i, x = of_n[at : at + PART], x_all[at : at + PART]
            own = (x * x).sum(axis=1)[:, None]
            # squares of distances, times 2 n^2
            gap, error = np.empty((len(i), len(b))), np.zeros(len(i))
            for m, (j, y) in far.items():
                if m == n:
                    size = (y * y).sum(axis=1)
                    gap[:, j] = np.c_[x, own, np.ones(len(x))] @ np.r_[-2.0 * y.T, np.ones((1, len(y))), size[None]]
                    error = 1e-9 * (own[:, 0] + np.fmax.reduce(size))
                else:
                    gap[:, j] = [[2.0 * n * n * gromov.slb_of(_even_steps(p, n), _even_steps(q, m)) ** 2 for q in y] for p in x]
            if itself:
                gap[np.arange(len(i)), i] = np.inf
            # the k-th nearest of some rows is no nearer than that of all
            some = gap[:, :: max(1, min(8, len(b) // (32 * k)))]
            kth = np.full(len(i), np.inf) if some.shape[1] <= k else np.partition(some, k - 1, axis=1)[:, k - 1]
            error = error + 1e-12 * np.abs(kth)
            most = 2.0 * n * n * (np.sqrt((np.maximum(kth, 0.0) + 2.0 * error) / (2.0 * n * n)) + 1.1 * 10.0**-places) ** 2
            u, v = np.nonzero(~(gap > most[:, None]))
            if itself:
                other = i[u] != v
                u, v = u[other], v[other]
            dist = np.empty(len(u))
            for m, (j, y) in far.items():
                place = np.zeros(len(b), np.int64)
                place[j] = np.arange(len(j))
                of_m = np.flatnonzero(sizes_b[v] == m)
                for start in range(0, len(of_m), EXACT):
                    e = of_m[start : start + EXACT]
                    p, q = x[u[e]], y[place[v[e]]]
                    dist[e] = 0.5 * np.sqrt(2.0 * ((p - q) ** 2).sum(axis=1) / (n * n)) if m == n else [gromov.slb_of(_even_steps(s, n), _even_steps(t, m)) for s, t in zip(p, q, strict=True)]
            dist = half_up(dist, places)
            order = np.lexsort((rank[v], dist, u))
            u, v, dist = u[order], v[order], dist[order]
            first = np.arange(len(u)) - np.searchsorted(u, u) < k
            out.append(pd.DataFrame({"first": names_a[i[u[first]]], "second": names_b[v[first]], "dist": dist[first]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["first", "second", "dist"])


def nearest_spaces(spaces: DataFrame, k: int, places: int) -> DataFrame:
    """nearest() of slb_uniform(), rounded to so many places, for ranked() spaces: a pair of blocks leaves the k nearest of each space, so that no
    table of all pairs is made."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        if not len(a) or b is not None and not len(b):
            return pd.DataFrame(columns=["first", "second", "dist"])
        a = a.reset_index(drop=True)
        if b is None:
            return nearest_of(a, a, k, places, True)
        b = b.reset_index(drop=True)
        return pd.concat([nearest_of(a, b, k, places, False), nearest_of(b, a, k, places, False)])

    found = by_blocks(spaces, kernel, "first string, second string, dist double", block=2 * SUMMED_BLOCK)
    order = Window.partitionBy("first").orderBy("dist", "second")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def quantile_steps(spaces: DataFrame) -> DataFrame:
    """(id, lo, hi, value): the quantile function of each space's distances as steps on [0, 1]."""
    entries = spaces.select("id", "n", "mass", F.posexplode("d").alias("k", "value"))
    root = F.floor((2 * F.col("n") - 1 - F.sqrt((2 * F.col("n") - 1).cast("double") * (2 * F.col("n") - 1) - 8 * F.col("k"))) / 2).cast("int")
    entries = entries.withColumn("i", root).withColumn("j", F.col("k") - F.col("n") * F.col("i") + (F.col("i") * (F.col("i") + 1) / 2).cast("int") + F.col("i") + 1)
    weighted = entries.select("id", "k", "value", (2 * F.element_at("mass", F.col("i") + 1) * F.element_at("mass", F.col("j").cast("int") + 1)).alias("w"))
    diagonal = spaces.select("id", F.lit(-1).alias("k"), F.lit(0.0).alias("value"), F.aggregate("mass", F.lit(0.0), lambda s, m: s + m * m).alias("w"))
    order = Window.partitionBy("id").orderBy("value", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weighted.unionByName(diagonal).withColumn("hi", F.sum("w").over(order)).select("id", (F.col("hi") - F.col("w")).alias("lo"), "hi", "value")


def slb_weighted(spaces: DataFrame, buckets: int = 16, pairs: DataFrame | None = None) -> DataFrame:
    """slb_pairwise() as a range join: steps meet in the buckets of [0, 1] that both reach, and each overlap counts in the bucket of its
    start."""
    from ..functions.columns import overlap

    steps = quantile_steps(spaces)
    bucket = lambda c: F.least(F.greatest(F.floor(c * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    spread = steps.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    a, b = (spread.selectExpr(f"id {name}", f"lo {s}lo", f"hi {s}hi", f"value {s}value", "bucket") for name, s in (("first", "a"), ("second", "b")))
    pairs = pair_index(spaces) if pairs is None else pairs.select("first", "second")
    met = pairs.join(a, "first").join(b, ["second", "bucket"]).filter(bucket(F.greatest("alo", "blo")) == F.col("bucket"))
    gap = (F.col("avalue") - F.col("bvalue")) * (F.col("avalue") - F.col("bvalue")) * overlap(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi"))
    return met.groupBy("first", "second").agg((0.5 * F.sqrt(F.greatest(F.sum(gap), F.lit(0.0)))).alias("slb"))


def space_of(row: dict) -> Space:
    return Space(square(np.asarray(row["d"], float), row["n"]), np.asarray(row["mass"], float))


def quantised(row: dict, clusters: int) -> gromov.Quantised:
    from ..functions.clusters import centroid_linkage

    x = space_of(row)
    return gromov.quantise(x, centroid_linkage(x.d, clusters))


def qgw_pairwise(spaces: DataFrame, clusters: int, wanted: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Quantised distances of all pairs, or of the wanted pairs (first, second). Spaces are clustered once, before they are paired."""
    schema = "first string, second string, dist double, method string, converged boolean"

    def solved(met: list) -> list[tuple]:
        rows = []
        for at in range(0, len(met), room(clusters, clusters)):
            part = met[at : at + room(clusters, clusters)]
            dist, converged = gromov.quantised_batch([(x[1], y[1]) for x, y in part], room)
            rows += [(x[0], y[0], d, "QGW", c) for (x, y), d, c in zip(part, dist.tolist(), converged.tolist(), strict=True)]
        return rows

    if wanted is not None:
        columns = ["id", "n", "d", "mass"]
        sides = [spaces.select(*[F.col(c).alias(f"{s}_{c}") for c in columns]).withColumnRenamed(f"{s}_id", name) for s, name in (("a", "first"), ("b", "second"))]

        def each(batches):
            memory: dict = {}
            for rows in batches:
                met, out = [], []
                for r in rows.to_dict("records"):
                    for name, s in (("first", "a"), ("second", "b")):
                        if r[name] not in memory:
                            memory[r[name]] = quantised({c: r[f"{s}_{c}"] for c in columns[1:]}, clusters)
                    met.append([(r[name], memory[r[name]]) for name in ("first", "second")])
                    if len(memory) > 500:
                        out, met = out + solved(met), []
                        memory.clear()
                yield _named(out + solved(met), [c.split()[0] for c in schema.split(", ")])

        return wanted.select("first", "second").join(sides[0], "first").join(sides[1], "second").repartition("first").mapInPandas(each, schema)

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        left = [(r["id"], quantised(r, clusters)) for r in a.to_dict("records")]
        right = left if b is None else [(r["id"], quantised(r, clusters)) for r in b.to_dict("records")]
        met = [sorted((left[i], right[j]), key=lambda t: t[0]) for i, j in couples(a, b)]
        return _named(solved(met), [c.split()[0] for c in schema.split(", ")])

    return by_blocks(spaces, kernel, schema, block=solver_block(spaces), group=group, costly=True, numbers=NUMBERS)


FUSED_SCHEMA = "first string, second string, dist double, gw_cost double, feature_cost double, converged boolean"


def fused_pairwise(spaces: DataFrame, penalties: dict[tuple[int, int], float], worst_increase: float | None = None, alpha: float = 0.5, group: str | None = None) -> DataFrame:
    """Fused distances of all pairs; spaces also have kinds, an int for each point."""
    rules = dict(penalties)

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        read = lambda rows: [(r["id"], space_of(r), tuple(r["kinds"])) for r in rows.to_dict("records")]
        left = read(a)
        right = left if b is None else read(b)
        out, same, features = [], {}, {}
        for i, j in couples(a, b):
            x, y = sorted((left[i], right[j]), key=lambda s: s[0])
            if (x[2], y[2]) not in features:
                features[x[2], y[2]] = gromov.penalty_matrix(rules, np.asarray(x[2]), np.asarray(y[2]))
            if len(x[1].mass) == len(y[1].mass) and np.ptp(x[1].mass) < 1e-12 and np.ptp(y[1].mass) < 1e-12:
                same.setdefault(len(x[1].mass), []).append((x, y))
            else:
                found, quadratic, linear = gromov.fused_with_budget(x[1], y[1], features[x[2], y[2]], worst_increase, alpha)
                out.append((x[0], y[0], found.dist, quadratic, linear, found.converged))
        for n, group in same.items():
            for at in range(0, len(group), room(n, n)):
                part = group[at : at + room(n, n)]
                found = gromov.fused_batch(np.stack([x[1].d for x, _ in part]), np.stack([y[1].d for _, y in part]), np.stack([features[x[2], y[2]] for x, y in part]), worst_increase, alpha)
                out += [(x[0], y[0], *row) for (x, y), row in zip(part, zip(*[f.tolist() for f in found], strict=True), strict=True)]
        return _named(out, [c.split()[0] for c in FUSED_SCHEMA.split(", ")])

    return by_blocks(spaces, kernel, FUSED_SCHEMA, group=group, costly=True, numbers=NUMBERS)


def kind_penalties(soma_dendrite: float, basal_apical: float, more: dict[tuple[int, int], float] | None = None) -> dict[tuple[int, int], float]:
    """Penalties of coupling somas (1) with dendrites (3, 4) and basal with apical dendrites."""
    return {(1, 3): soma_dendrite, (1, 4): soma_dendrite, (3, 4): basal_apical} | (more or {})


def sampled_pairs(spaces: DataFrame, most: int) -> DataFrame:
    """`most` different pairs, drawn among the 2 * most spaces whose ids hash lowest; all pairs, if there are no more. Only those ids come to the
    driver."""
    ids = sorted(r.id for r in spaces.select("id").orderBy(F.xxhash64("id"), "id").limit(2 * most).collect())
    n = len(ids)
    ranks = range(n * (n - 1) // 2)
    drawn = ranks if len(ranks) <= most else np.random.default_rng(0).choice(len(ranks), most, replace=False)
    first, second = np.triu_indices(n, 1)
    return spaces.sparkSession.createDataFrame([(ids[first[k]], ids[second[k]]) for k in map(int, drawn)], "first string, second string")


def penalty_scale(spaces: DataFrame, penalties: dict, most: int = 100, quantile: float = 0.15) -> float | None:
    """A quantile, over a sample of pairs, of the plain optimum's GW cost per feature cost."""
    found = gw_for(spaces, sampled_pairs(spaces, most), plans=True)
    kinds = spaces.select("id", "kinds")
    met = found.join(kinds.selectExpr("id first", "kinds a"), "first").join(kinds.selectExpr("id second", "kinds b"), "second")
    rule = F.create_map(*[F.lit(x) for (p, q), v in penalties.items() for a, b in {(p, q), (q, p)} for x in (f"{a}:{b}", float(v))])
    key = F.concat_ws(":", F.element_at("a", F.col("e.i") + 1), F.element_at("b", F.col("e.j") + 1))
    costs = met.select("first", "second", "dist", "a", "b", F.explode(F.arrays_zip("i", "j", "mass")).alias("e")).withColumn("c", F.coalesce(F.try_element_at(rule, key), F.lit(0.0)) * F.col("e.mass"))
    ratio = costs.groupBy("first", "second").agg(F.sum("c").alias("c"), F.first("dist").alias("dist")).filter("c > 0").select((4 * F.col("dist") * F.col("dist") / F.col("c")).alias("r"))
    return ratio.agg(F.percentile("r", quantile)).first()[0]


def gw_for(spaces: DataFrame, wanted: DataFrame, plans: bool = False) -> DataFrame:
    """Distances of wanted pairs (first, second) only."""
    columns = ["n", "d", "mass"]
    sides = [spaces.select(F.col("id").alias(name), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s, name in (("a", "first"), ("b", "second"))]
    schema = PLAN_SCHEMA if plans else GW_SCHEMA

    def each(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                pair = pd.DataFrame([{"id": r[name], **{c: r[f"{s}_{c}"] for c in columns}} for s, name in (("a", "first"), ("b", "second"))])
                out.append(gw_kernel(pair.iloc[:1], pair.iloc[1:], plans))
            if out:
                yield pd.concat(out)

    return wanted.select("first", "second").join(sides[0], "first").join(sides[1], "second").mapInPandas(each, schema)


UNBALANCED_SCHEMA = "first string, second string, gw double, kl_x double, kl_y double, kl_plan double, total double, value double, eps double"


def unbalanced_pairwise(spaces: DataFrame, mass_kept: float, eps: float, rho: float | None = None, quantile: float = 0.15, sample: int = 100, group: str | None = None) -> DataFrame:
    """Unbalanced distances of all pairs. rho None: from a quantile of the GW cost of sampled pairs, so that those keep mass_kept of their
    mass."""
    if rho is None:
        cost = gw_for(spaces, sampled_pairs(spaces, sample)).agg(F.percentile(4 * F.col("dist") * F.col("dist"), quantile)).first()[0]
        rho = gromov.rho_of(cost, mass_kept)

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        read = lambda rows: list(zip(rows.id, spaces_of(rows), strict=True))
        left = read(a)
        right = left if b is None else read(b)
        rows, alike = [], {}
        for i, j in couples(a, b):
            x, y = sorted((left[i], right[j]), key=lambda s: s[0])
            alike.setdefault((len(x[1].mass), len(y[1].mass)), []).append((x, y))
        for (n, m), met in alike.items():
            for at in range(0, len(met), room(n, m)):
                part = met[at : at + room(n, m)]
                sides = [np.stack([getattr(pair[s][1], c) for pair in part]) for s in (0, 1) for c in ("d", "mass")]
                rows += [(x[0], y[0], u.gw, u.kl_x, u.kl_y, u.kl_plan, u.total, u.value, u.eps) for (x, y), u in zip(part, gromov.unbalanced_batch(*sides, rho, rho, eps), strict=True)]
        return _named(rows, [c.split()[0] for c in UNBALANCED_SCHEMA.split(", ")])

    return by_blocks(spaces, kernel, UNBALANCED_SCHEMA, group=group, costly=True, numbers=NUMBERS)


def anchored(spaces: DataFrame, anchors: int, first: str, distance: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """Upper bounds of all distances by the triangle inequality over a few anchors: each next anchor is the space farthest from those before. One
    job of N distances for each anchor; the bounds join on the anchor."""
    chosen, found = [first], None
    for _ in range(anchors):
        name = chosen[-1]
        d = distance(spaces, spaces.filter(F.col("id") == name))
        to = d.select(F.when(F.col("first") == name, F.col("second")).otherwise(F.col("first")).alias("id"), F.lit(name).alias("anchor"), "dist")
        to = to.unionByName(spaces.filter(F.col("id") == name).select("id", F.lit(name).alias("anchor"), F.lit(0.0).alias("dist")))
        found = materialise(to if found is None else found.unionByName(to), "anchors")
        nearest = found.groupBy("id").agg(F.min("dist").alias("near")).orderBy(F.desc("near"), "id").first()
        if len(chosen) == anchors or nearest is None or nearest.near == 0:
            break
        chosen.append(nearest.id)
    return min_plus(found), chosen


def min_plus(to_anchors: DataFrame, pairs: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """(first, second, dist): the least sum of distances through an anchor, from rows (id, anchor, dist), for the given pairs or for all (of one
    group)."""
    keys = ["id", *([group] if group else [])]
    vector = to_anchors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("anchor", "dist"))).alias("v"))
    if pairs is None:
        met = pair_rows(vector, ["v"], "id", group)
    else:
        met = pairs.join(vector.selectExpr("id first", "v a_v"), "first").join(vector.selectExpr("id second", "v b_v"), "second")
    sums = F.transform(F.map_keys("a_v"), lambda k: F.element_at("a_v", k) + F.element_at("b_v", k))
    return met.select("first", "second", F.array_min(sums).alias("dist"))


def random_pairs(ids: DataFrame, n_pairs: int | None, seed: int = 0) -> DataFrame:
    """Pairs first < second of column id without repeats: all, or n_pairs of them in the order of a hash with the seed."""
    pairs = pair_index(ids)
    return pairs if n_pairs is None else pairs.orderBy(F.xxhash64(F.lit(seed), "first", "second"), "first", "second").limit(n_pairs)


def split_pairs(ids: DataFrame, n_pairs: int | None, proportions: dict[str, float], seed: int = 0) -> DataFrame:
    """(part, first, second): ids are dealt to parts by a hash, in the given proportions, and pairs stay within a part."""
    share = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    part, upto, whole = F.lit(None).cast("string"), 0.0, sum(proportions.values())
    for name, p in reversed(list(proportions.items())):
        part = F.when(share < 1 - upto / whole, F.lit(name)).otherwise(part)
        upto += p
    dealt = materialise(ids.select("id").withColumn("part", part), "parts")
    out = None
    for name, p in proportions.items():
        rows = random_pairs(dealt.filter(F.col("part") == name), None if n_pairs is None else round(n_pairs * p / whole), seed).select(F.lit(name).alias("part"), "first", "second")
        out = rows if out is None else out.unionByName(rows)
    return out


def embedding_distances(embeddings: DataFrame, pairs: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """(first, second, dist): squared Euclidean distances of embeddings (id, vector), for the given pairs or for all (of one group)."""
    from ..functions.columns import squared_euclidean

    if pairs is None:
        met = pair_rows(embeddings, ["vector"], "id", group)
    else:
        met = pairs.join(embeddings.selectExpr("id first", "vector a_vector"), "first").join(embeddings.selectExpr("id second", "vector b_vector"), "second")
    return met.select("first", "second", squared_euclidean(F.col("a_vector"), F.col("b_vector")).alias("dist"))


def mapped_distances(ground: np.ndarray, mapped: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(first, second, channel, dist): exact transport between distributions (id, channel, mass) on an anchor's points, whose distance matrix is
    `ground`. It has the size of one cell and goes with the task. Distributions that many cells have are compared once (see COPIES), and all pairs
    of cells look their distance up."""
    from ..functions.transport import emd_cost

    def solved(met: DataFrame, names: list[str], schema: str) -> DataFrame:
        def each(batches):
            for rows in batches:
                yield rows[names].assign(dist=[emd_cost(np.asarray(a, float), np.asarray(b, float), ground) for a, b in zip(rows.a, rows.b, strict=True)])

        return met.mapInPandas(each, schema + ", dist double")

    named = ["first", "second", "channel"], "first string, second string, channel string"
    if pairs is not None:
        met = pairs.join(mapped.selectExpr("id first", "channel", "mass a"), "first").join(mapped.selectExpr("id second", "channel", "mass b"), ["second", "channel"])
        return solved(met, *named)
    keyed = mapped.select("id", "channel", "mass", F.sha2(F.to_json(F.struct("mass")), 256).alias("key"))
    alike = materialise(keyed.groupBy("channel", "key").agg(F.first("mass").alias("mass"), F.count("*").alias("n")).withColumn("alike", F.monotonically_increasing_id()), "alike")
    rows, different = alike.agg(F.sum("n"), F.count("*")).first()
    if COPIES * different > (rows or 0):
        return solved(pair_rows(mapped, ["channel", "mass"], "id", "channel").selectExpr("first", "second", "a_channel channel", "a_mass a", "b_mass b"), *named)
    unlike = pair_rows(alike, ["mass"], "alike", "channel").selectExpr("first p", "second q", "a_mass a", "b_mass b")
    itself = alike.filter("n > 1").selectExpr("alike p", "alike q", "mass a", "mass b")
    # few bytes, but long to solve
    dealt = unlike.unionByName(itself).repartition(min(MOST_TASKS, max(1, different * (different + 1) // 32)), "p", "q")
    dist = small(materialise(solved(dealt, ["p", "q"], "p long, q long"), "unlike"), 64)
    of_cells = materialise(keyed.drop("mass").join(small(alike.select("channel", "key", "alike"), 256), ["channel", "key"]).drop("key"), "alike-cells")
    met = pair_rows(of_cells, ["channel", "alike"], "id", "channel").withColumns({"p": F.least("a_alike", "b_alike"), "q": F.greatest("a_alike", "b_alike")})
    return met.join(dist, ["p", "q"]).select("first", "second", F.col("a_channel").alias("channel"), "dist")


def symmetric(distances: DataFrame) -> DataFrame:
    return distances.select("first", "second", "dist").unionByName(distances.select(F.col("second").alias("first"), F.col("first").alias("second"), "dist"))


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """(first, second, dist, rank): the k nearest others of each; ties by name."""
    order = Window.partitionBy("first").orderBy("dist", "second")
    return symmetric(distances).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def clouds(points: Column) -> Column:
    """Condensed distances of arrays of coordinates."""
    from ..functions.columns import pdist

    return pdist(points)


