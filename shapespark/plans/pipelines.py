"""Whole runs from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adaptive, images, pairs, sampling, trees
from ..sources import swc, tables
from ..storage import materialise


def traces_to_icdm(spark: SparkSession, folder: str, out: str, n_points: int, metric: str = "euclidean", preprocess=None) -> DataFrame:
    """Trace files to a CSV of condensed distances and a table of kinds at out/types; returns rejected cells (cell_id, stage, reason).
    preprocess: nodes -> (accepted nodes, rejected cells)."""
    nodes = materialise(swc.read_swc(spark, folder), "nodes")
    rejected = None
    if preprocess is not None:
        nodes, rejected = preprocess(nodes)
    sampled = materialise(sampling.sample_traces(nodes, n_points, metric), "sampled")
    tables.write_icdm(sampling.icdm_of(sampled), f"{out}/icdm", n_points)
    sampled.filter("reason is null").select("cell_id", "kinds").write.parquet(f"{out}/types")
    failed = sampling.failures(sampled)
    return failed if rejected is None else failed.unionByName(rejected)


def meshes_to_icdm(spark: SparkSession, folder: str, out: str, n_points: int = 50, metric: str = "geodesic", segment: bool = True) -> DataFrame:
    vertices, faces = tables.read_obj(spark, folder)
    sampled = materialise(sampling.sample_meshes(vertices, faces, n_points, metric, segment), "sampled")
    tables.write_icdm(sampling.icdm_of(sampled), out, n_points)
    return sampling.failures(sampled)


def rasters_to_icdm(pixels: DataFrame, out: str, n_points: int, background: int = 0, discard_holes: bool = False, only_longest: bool = False) -> DataFrame:
    """From a table of pixels (image_id, r, c, label); image files are decoded elsewhere."""
    sampled = materialise(sampling.sample_outlines(pixels, n_points, background, discard_holes, only_longest), "sampled")
    tables.write_icdm(sampling.icdm_of(sampled), out, n_points)
    return sampling.failures(sampled)


def spaces_of(icdm: DataFrame) -> DataFrame:
    """Spaces with equal masses from (cell_id, n, d)."""
    return icdm.select(F.col("cell_id").alias("id"), "n", "d", F.expr("transform(sequence(1, n), x -> 1.0D / n)").alias("mass"))


def gw_matrix(spark: SparkSession, icdm: str, out: str, plans: str | None = None) -> DataFrame:
    """A CSV of condensed distances to one of distances between all cells, and their plans if a place for them is given."""
    found = materialise(pairs.gw_pairwise(spaces_of(tables.read_icdm(spark, icdm)), plans is not None), "gw")
    tables.write_distances(found, out)
    if plans is not None:
        tables.write_couplings(pairs.couplings(found), plans)
    return found.select("first", "second", "dist", "method", "converged")


def gw_matrix_query_target(spark: SparkSession, queries: str, targets: str, out: str, plans: str | None = None) -> DataFrame:
    both = [spaces_of(tables.read_icdm(spark, p)) for p in (queries, targets)]
    found = materialise(pairs.gw_query_target(*both, plans is not None), "gw")
    tables.write_distances(found, out)
    if plans is not None:
        tables.write_couplings(pairs.couplings(found), plans)
    return found.select("first", "second", "dist", "method", "converged")


def slb_matrix(spark: SparkSession, icdm: str, out: str) -> None:
    found = pairs.slb_pairwise(spaces_of(tables.read_icdm(spark, icdm)))
    found.toDF("first_object", "second_object", "slb_dist").write.csv(out, header=True)


def qgw_matrix(spark: SparkSession, icdm: str, clusters: int, out: str) -> None:
    found = pairs.qgw_pairwise(spaces_of(tables.read_icdm(spark, icdm)), clusters)
    found.select("first", "second", "dist").toDF("first_object", "second_object", "quantized_gw").write.csv(out, header=True)


def neighbours_matrix(spark: SparkSession, icdm: str, out: str, clusters: int, accuracy: float, k: int) -> None:
    """Pruned quantised distances with their source, QGW or EST, and a header."""
    found = adaptive.adaptive_neighbours(spaces_of(tables.read_icdm(spark, icdm)), clusters, accuracy, k)
    found.toDF("first_object", "second_object", "dist", "source").write.csv(out, header=True)


def fused_matrix(spark: SparkSession, icdm: str, types: DataFrame, out: str, soma_dendrite: float, basal_apical: float, more: dict | None = None, worst_increase: float | None = None, adjust: bool = False, sample: int = 100, quantile: float = 0.15) -> DataFrame:
    """Fused distances with penalties for coupling points of different kinds; adjust scales them by a quantile over sampled pairs."""
    cells = tables.load_cells(spark, icdm, types.select("cell_id", "kinds")).withColumnRenamed("cell_id", "id")
    penalties = pairs.kind_penalties(soma_dendrite, basal_apical, more)
    if adjust:
        scale = pairs.penalty_scale(cells, penalties, sample, quantile) or 1.0
        penalties = {k: v * scale for k, v in penalties.items()}
    found = materialise(pairs.fused_pairwise(cells, penalties, worst_increase), "fused")
    found.select("first", "second", "dist").toDF("first_object", "second_object", "fgw_dist").write.csv(out, header=True)
    return found


def partial_matching(spark: SparkSession, folder: str, first_cells: int, n_points: int, shares: list[float], out: str, seed: int = 0) -> DataFrame:
    """The first cells by name whose soma is a single root, trimmed by each share, sampled, and compared."""
    nodes = swc.read_swc(spark, folder)
    names = nodes.select("cell_id").distinct().orderBy("cell_id").limit(first_cells)
    kept, _ = trees.soma_filter(materialise(nodes.join(names, "cell_id", "left_semi"), "nodes"), None, True, strict=True)
    trimmed = materialise(trees.trim(kept, shares, seed), "trimmed")
    found = materialise(pairs.gw_pairwise(spaces_of(sampling.icdm_of(sampling.sample_traces(trimmed, n_points)))), "gw")
    tables.write_distances(found, out)
    return found


def signal_distances(cells: DataFrame, channels: list[str], anchor: str | None = None, **options) -> DataFrame:
    """Distances of signals: boundaries are compared to find a central cell (or take the given one), signals are mapped to it, and compared
    there."""
    import numpy as np

    cells = materialise(cells, "cells")
    if anchor is None:
        anchor = images.centroid(materialise(pairs.gw_pairwise(images.boundary_spaces(cells)), "boundaries"))
    ground = images.cell_matrix(np.asarray(cells.filter(F.col("cell_id") == anchor).first().coords))
    return pairs.mapped_distances(ground, materialise(images.map_to_anchor(cells, anchor, channels, **options), "mapped").select("id", "channel", "mass"))
