"""Forests of traced nodes. A cell's nodes meet once, in one shuffle by cell, and a kernel annotates them with everything that traversals
give: root, component, depth, order, path lengths. What follows are plain filters and aggregations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ANNOTATED, WEIGHTED
from ..sources.swc import ordered
from ..storage import materialise

SOMA = 1


class Broken(ValueError):
    """A cell whose parents aren't a forest."""


def traverse(ids: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes in file order: index of each parent (-1 for roots), depth, and the breadth-first order. Children keep file order."""
    n = len(ids)
    sort = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[sort], parents)
    known = (at < n) & (ids[sort[np.minimum(at, n - 1)]] == parents)
    root = parents == -1
    if not (known | root).all():
        raise Broken(f"node {ids[~(known | root)][0]} has an unknown parent")
    up = np.where(root, -1, sort[np.minimum(at, n - 1)])
    depth = np.full(n, -1)
    children = np.argsort(up, kind="stable")
    first = np.searchsorted(up[children], np.arange(n))
    last = np.searchsorted(up[children], np.arange(n), side="right")
    order, level, d = [], np.flatnonzero(root), 0
    while len(level):
        depth[level] = d
        order.append(level)
        counts = last[level] - first[level]
        offset = np.repeat(first[level] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        level, d = children[offset], d + 1
    if (depth < 0).any():
        raise Broken("parents form a circle")
    return up, depth, np.concatenate(order) if order else np.empty(0, np.int64)


def annotate_cell(cell: pd.DataFrame) -> pd.DataFrame:
    cell = cell.sort_values("line_no", kind="stable").reset_index(drop=True)
    up, depth, order = traverse(cell.node_id.to_numpy(), cell.parent_id.to_numpy())
    n, xyz = len(cell), cell[["x", "y", "z"]].to_numpy(float)
    edge = np.where(up >= 0, np.sqrt(((xyz - xyz[up]) ** 2).sum(axis=1)), 0.0)
    root, dist, below, height = np.arange(n), np.zeros(n), np.zeros(n), np.zeros(n, int)
    levels = [order[depth[order] == d] for d in range(depth.max() + 1)]
    for level in levels[1:]:
        root[level] = root[up[level]]
        dist[level] = dist[up[level]] + edge[level]
    for level in reversed(levels[1:]):
        np.add.at(below, up[level], below[level] + edge[level])
        np.maximum.at(height, up[level], height[level] + 1)
    roots, size = np.unique(root, return_counts=True)
    rank = np.empty(len(roots), int)
    rank[np.lexsort((roots, -size))] = np.arange(len(roots))
    component = np.searchsorted(roots, root)
    place = np.empty(n, int)
    place[order] = np.arange(n)
    position = np.empty(n, int)
    position[np.lexsort((place, depth, rank[component]))] = np.arange(1, n + 1)
    return cell.assign(root_id=cell.node_id.to_numpy()[root], component_rank=rank[component], component_size=size[component], depth=depth, position=position, n_children=np.bincount(up[up >= 0], minlength=n), edge=edge, dist_root=dist, subtree_length=below, height=height)


def _per_cell(cell: pd.DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """kernel(cell), or a row that only says why not."""
    try:
        return kernel(cell).assign(reason=None).reindex(columns=[*columns, "reason"])
    except Broken as why:
        return pd.DataFrame([{"cell_id": cell.cell_id.iloc[0], "reason": str(why)}]).reindex(columns=[*columns, "reason"])


def annotate_all(nodes: DataFrame) -> DataFrame:
    """Annotated nodes and, for cells that aren't forests, one row with nothing but cell_id and reason."""
    columns = [c.split()[0] for c in ANNOTATED.split(", ")]
    source = ordered(nodes).select(*columns[:8], "line_no")
    return source.groupBy("cell_id").applyInPandas(lambda cell: _per_cell(cell, annotate_cell, columns), f"{ANNOTATED}, reason string")


def annotate(nodes: DataFrame) -> DataFrame:
    """Nodes with root, component rank (larger components first), depth, breadth-first position, child count, lengths and height."""
    return annotate_all(nodes).filter("reason is null").drop("reason")


def broken_cells(nodes: DataFrame) -> DataFrame:
    return annotate_all(nodes).filter("reason is not null").select("cell_id", F.lit("forest").alias("stage"), "reason")


def linearize(nodes: DataFrame) -> DataFrame:
    """Nodes renumbered from 1, breadth first, one component after another by size; roots have parent -1."""
    annotated = materialise(annotate(nodes), "annotated")
    number = annotated.select("cell_id", F.col("node_id").alias("parent_id"), F.col("position").cast("long").alias("new_parent"))
    return annotated.join(number, ["cell_id", "parent_id"], "left").select("cell_id", F.col("position").cast("long").alias("node_id"), "structure_id", "x", "y", "z", "radius", F.coalesce("new_parent", F.lit(-1).cast("long")).alias("parent_id"))


def components(nodes: DataFrame) -> DataFrame:
    """(cell_id, root_id, component_rank, n_nodes, has_soma, total_length, weighted_depth, discrete_depth)."""
    return annotate(nodes).groupBy("cell_id", "root_id", "component_rank").agg(
        F.count("*").alias("n_nodes"), F.bool_or(F.col("structure_id") == SOMA).alias("has_soma"), F.sum("edge").alias("total_length"), F.max("dist_root").alias("weighted_depth"), F.max("depth").alias("discrete_depth")
    )


def type_counts(nodes: DataFrame, *keys: str) -> DataFrame:
    return nodes.groupBy("cell_id", *keys, "structure_id").agg(F.count("*").alias("n"))


def branching_degree(nodes: DataFrame) -> DataFrame:
    """The number of children of every node."""
    counts = nodes.filter("parent_id <> -1").groupBy("cell_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("cell_id", "node_id").join(counts, ["cell_id", "node_id"], "left").select("cell_id", "node_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def edge_lengths(nodes: DataFrame) -> DataFrame:
    """(cell_id, node_id, edge): the distance of each node that isn't a root from its parent."""
    parent = nodes.select("cell_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    squares = [(F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz"]
    return nodes.join(parent, ["cell_id", "parent_id"]).select("cell_id", "node_id", F.sqrt(squares[0] + squares[1] + squares[2]).alias("edge"))


def total_length(nodes: DataFrame) -> DataFrame:
    """(cell_id, total_length); a cell of one node has 0."""
    edges = edge_lengths(nodes).groupBy("cell_id").agg(F.sum("edge").alias("total_length"))
    return nodes.select("cell_id").distinct().join(edges, "cell_id", "left").select("cell_id", F.coalesce("total_length", F.lit(0.0)).alias("total_length"))


def filter_forest(nodes: DataFrame, test: Column) -> DataFrame:
    """The forest that the nodes passing the test induce: those whose parent goes become roots."""
    kept = nodes.filter(test)
    there = kept.select("cell_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    columns = kept.columns
    return kept.join(there, ["cell_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id")).otherwise(F.lit(-1).cast("long"))).select(columns)


def keep_only(nodes: DataFrame, kinds: list[int]) -> DataFrame:
    return filter_forest(nodes, F.col("structure_id").isin(kinds))


def soma_filter(nodes: DataFrame, kinds: list[int] | None = None, soma_component_only: bool = True, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted nodes and rejected cells. With soma_component_only a cell must have exactly one root that is a soma. Kinds None keeps all kinds:
    then the whole forest of an accepted cell stays, or with strict its soma component; with kinds, nodes of those within the soma component."""
    if not soma_component_only:
        return (nodes if kinds is None else keep_only(nodes, kinds)), nodes.sparkSession.createDataFrame([], "cell_id string, stage string, reason string")
    annotated = materialise(annotate(nodes), "annotated")
    somas = annotated.groupBy("cell_id").agg(F.sum(F.when((F.col("depth") == 0) & (F.col("structure_id") == SOMA), 1).otherwise(0)).alias("n"), F.max(F.when((F.col("depth") == 0) & (F.col("structure_id") == SOMA), F.col("node_id"))).alias("soma"))
    rejected = somas.filter("n <> 1").select("cell_id", F.lit("preprocess").alias("stage"), F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" soma root nodes, not 1.")).alias("reason"))
    good = annotated.join(somas.filter("n = 1").select("cell_id", "soma"), "cell_id")
    if strict or kinds is not None:
        good = good.filter("root_id = soma")
    good = good.select("cell_id", "node_id", "structure_id", "x", "y", "z", "radius", "parent_id")
    return (good if kinds is None else keep_only(good, kinds)), rejected


def largest_component(nodes: DataFrame, kinds: list[int] | None = None) -> DataFrame:
    """Nodes of the given kinds in the component that was first before filtering by size; without kinds, the largest component."""
    source = nodes if kinds is None else keep_only(nodes, kinds)
    return annotate(source).filter("component_rank = 0").select("cell_id", "node_id", "structure_id", "x", "y", "z", "radius", "parent_id")


def failing(nodes: DataFrame, test: Column) -> DataFrame:
    """Cells that fail a test over their nodes (an aggregate expression)."""
    return nodes.groupBy("cell_id").agg(test.alias("ok")).filter(~F.col("ok")).select("cell_id")


def same_forest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cell_id, same): whether both tables hold equal forests, after renumbering."""
    columns = ["cell_id", "node_id", "structure_id", "x", "y", "z", "radius", "parent_id"]
    left, right = (materialise(linearize(t).select(columns), "linear") for t in (a, b))
    differing = left.exceptAll(right).union(right.exceptAll(left)).select("cell_id").distinct().withColumn("differs", F.lit(True))
    cells = left.select("cell_id").union(right.select("cell_id")).distinct()
    return cells.join(differing, "cell_id", "left").select("cell_id", F.col("differs").isNull().alias("same"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(cell_id, node_id, place) of a depth-first walk."""

    def walk(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("line_no", kind="stable").reset_index(drop=True)
        up, _, _ = traverse(cell.node_id.to_numpy(), cell.parent_id.to_numpy())
        below: dict[int, list[int]] = {}
        for i, p in enumerate(up.tolist()):
            below.setdefault(p, []).append(i)
        out, stack = [], below.get(-1, [])[::-1]
        while stack:
            out.append(stack.pop())
            stack += below.get(out[-1], [])[::-1]
        return pd.DataFrame({"cell_id": cell.cell_id.iloc[0], "node_id": cell.node_id.to_numpy()[out], "place": np.arange(len(out))})

    return ordered(nodes).groupBy("cell_id").applyInPandas(walk, "cell_id string, node_id long, place int")


def contract_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """Only roots, branchings and ends of an annotated cell, linked to the next such node above."""
    cell = cell.sort_values("position")
    ids, parents, kinds, dist = (cell[c].to_numpy() for c in ("node_id", "parent_id", "structure_id", "dist_root"))
    sort = np.argsort(ids)
    up = np.where(parents == -1, -1, sort[np.minimum(np.searchsorted(ids[sort], parents), len(ids) - 1)])
    stays = (parents == -1) | (cell.n_children.to_numpy() != 1)
    # the nearest staying ancestor, by doubling steps over nodes that go
    above = up.copy()
    while True:
        going = (above >= 0) & ~stays[above]
        if not going.any():
            break
        above[going] = above[above[going]]
    depth, at = np.zeros(len(ids), int), above.copy()
    while (at >= 0).any():
        depth[at >= 0] += 1
        at = np.where(at >= 0, above[at], -1)
    kept = np.flatnonzero(stays)
    over = above[kept]
    values = (cell.cell_id.iloc[0], ids[kept], np.where(over >= 0, ids[over], -1), np.where(over >= 0, dist[kept] - dist[over], 0.0), depth[kept], kinds[kept], dist[kept])
    return pd.DataFrame(dict(zip([c.split()[0] for c in WEIGHTED.split(", ")], values, strict=True)))


def contract(nodes: DataFrame) -> DataFrame:
    """Weighted trees: nodes with one parent and one child go, and edge lengths add up."""
    return annotate(nodes).groupBy("cell_id").applyInPandas(contract_cell, WEIGHTED)


def path_length(nodes: DataFrame) -> DataFrame:
    """(cell_id, a, b, length) along the tree for all pairs a < b of one component of the contracted tree, through their lowest common
    ancestor."""

    def lengths(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values(["depth", "node_id"]).reset_index(drop=True)
        index = {n: i for i, n in enumerate(tree.node_id)}
        chain: list[list[int]] = []
        for i, p in enumerate(tree.parent_id):
            chain.append([*(chain[index[p]] if p != -1 else []), i])
        dist, ids, rows = tree.dist_root.to_numpy(), tree.node_id.to_numpy(), []
        for i in range(len(tree)):
            for j in range(i + 1, len(tree)):
                if chain[i][0] == chain[j][0]:
                    common = sum(1 for a, b in zip(chain[i], chain[j], strict=False) if a == b)
                    rows.append((tree.cell_id[0], min(ids[i], ids[j]), max(ids[i], ids[j]), dist[i] + dist[j] - 2 * dist[chain[i][common - 1]]))
        return pd.DataFrame(rows, columns=["cell_id", "a", "b", "length"])

    return contract(nodes).groupBy("cell_id").applyInPandas(lengths, "cell_id string, a long, b long, length double")


def seeded(*key) -> np.random.Generator:
    """A generator that depends on its key alone."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "little"))


def interpolated(a: np.ndarray, b: np.ndarray, distance: float) -> np.ndarray:
    """The point at a distance from a towards b."""
    return a + (b - a) * (distance / np.linalg.norm(b - a))


def trim_cell(cell: pd.DataFrame, share: float, rng: np.random.Generator) -> pd.DataFrame:
    """A tree without a random part that has the given share of its length. From the root, a child is drawn by the length of its branch; a
    branch shorter than what is left to cut goes whole, one whose stem alone can pay for the rest is shortened, and else the walk goes down."""
    cell = annotate_cell(cell)
    left = share * float(cell.subtree_length[cell.parent_id == -1].sum())
    length = dict(zip(cell.node_id, cell.subtree_length, strict=True))
    edge = dict(zip(cell.node_id, cell.edge, strict=True))
    place = {n: np.array(p) for n, p in zip(cell.node_id, cell[["x", "y", "z"]].to_numpy(float), strict=True)}
    below: dict[int, list[int]] = {}
    for n, p in zip(cell.node_id, cell.parent_id, strict=True):
        below.setdefault(p, []).append(n)
    gone: set[int] = set()
    at = below[-1][0]
    while left > 1e-12 and below.get(at):
        weights = np.array([edge[c] + length[c] for c in below[at]])
        if weights.sum() <= 0:
            break
        child = below[at][int(np.searchsorted(np.cumsum(weights), rng.uniform(0, weights.sum()), side="right").clip(0, len(weights) - 1))]
        if edge[child] + length[child] <= left:
            left -= edge[child] + length[child]
            below[at].remove(child)
            gone.add(child)
        elif left >= length[child]:
            place[child] = interpolated(place[at], place[child], edge[child] - (left - length[child]))
            gone.update(below.pop(child, []))
            left = 0.0
        else:
            at = child
    kept: list[int] = []
    for n, p in zip(*cell.sort_values("position")[["node_id", "parent_id"]].to_numpy().T, strict=True):
        if n in gone or p in gone:
            gone.add(n)
        else:
            kept.append(n)
    out = cell[cell.node_id.isin(kept)].copy()
    out[["x", "y", "z"]] = np.array([place[n] for n in out.node_id])
    return out[["cell_id", "node_id", "structure_id", "x", "y", "z", "radius", "parent_id"]]


def trim(nodes: DataFrame, shares: list[float], seed: int = 0) -> DataFrame:
    """Trimmed copies of one-tree cells, one for each share; cell_id gets the share as a suffix."""
    source = ordered(nodes).select("cell_id", "node_id", "structure_id", "x", "y", "z", "radius", "parent_id", "line_no").withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))

    def cut(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        out = trim_cell(cell, key[1], seeded(key[0], key[1], seed))
        return out.assign(cell_id=f"{key[0]}_{key[1]:g}")

    return source.groupBy("cell_id", "share").applyInPandas(cut, "cell_id string, node_id long, structure_id int, x double, y double, z double, radius double, parent_id long")
