"""Operators on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shapespark.functions import columns
from shapespark.operators import adaptive, graphs, images, pairs, sampling, statistics, trees
from shapespark.plans import pipelines
from shapespark.sources import swc, tables
from shapespark.streaming.arrivals import compare_arrivals
from shapespark.storage import materialise

FORK = "# a comment\n1 1 0 0 0 1 -1\n2 3 3 0 0 1 1\n3 3 6 0 0 1 2\n4 4 6 4 0 1 3\n5 3 6 -4 0 1 3\n10 2 50 0 0 1 -1\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("swc")
    (path / "fork.swc").write_text(FORK)
    (path / "win.SWC").write_text("1 1 0 0 0 1 -1\r\n2 3 0 0 8 1 1\r\n2 3 0 0 9 1 1\r\n")
    (path / "lost.swc").write_text("1 1 0 0 0 1 -1\n2 3 0 0 1 1 77\n")
    (path / "ring.swc").write_text("1 1 0 0 0 1 -1\n2 3 0 0 1 1 3\n3 3 0 0 2 1 2\n")
    (path / "none.swc").write_text("1 3 0 0 0 1 -1\n2 3 0 0 1 1 1\n")
    (path / ".hidden.swc").write_text("junk")
    (path / "notes.txt").write_text("junk")
    return str(path)


def test_read_names_and_broken_cells(spark, folder):
    nodes = swc.read_swc(spark, folder)
    assert {r.cell_id for r in nodes.select("cell_id").distinct().collect()} == {"fork", "win", "lost", "ring", "none"}
    assert {r.cell_id for r in swc.file_names(spark, folder).collect()} >= {"fork", "win"}
    assert nodes.filter("cell_id = 'win' and node_id = 2").first().z == 9.0
    assert {r.cell_id: r.reason for r in trees.broken_cells(nodes).collect()} == {"lost": "node 2 has an unknown parent", "ring": "parents form a circle"}


def test_short_lines_raise(spark):
    lines = spark.createDataFrame([("a", 0, "1 2 3")], "cell_id string, line_no int, value string")
    with pytest.raises(Exception, match="fewer than seven fields"):
        swc.parse_lines(lines).collect()


def test_forest_operators(spark, folder):
    nodes = materialise(swc.read_swc(spark, folder).filter("cell_id in ('fork', 'win', 'none')"), "nodes")
    parts = {(r.cell_id, r.component_rank): r for r in trees.components(nodes).collect()}
    fork = parts["fork", 0]
    assert (fork.n_nodes, fork.has_soma, fork.total_length, fork.weighted_depth, fork.discrete_depth) == (5, True, 14.0, 10.0, 3) and parts["fork", 1].n_nodes == 1
    wt = {r.node_id: (r.parent_id, r.dist) for r in trees.contract(nodes.filter("cell_id = 'fork'")).collect()}
    assert wt == {1: (-1, 0.0), 3: (1, 6.0), 4: (3, 4.0), 5: (3, 4.0), 10: (-1, 0.0)}
    lengths = {(r.a, r.b): r.length for r in trees.path_length(nodes.filter("cell_id = 'fork'")).collect()}
    assert lengths == {(1, 3): 6.0, (1, 4): 10.0, (1, 5): 10.0, (3, 4): 4.0, (3, 5): 4.0, (4, 5): 8.0}
    ok, bad = trees.soma_filter(nodes, [3])
    assert [(r.cell_id, r.reason) for r in bad.collect()] == [("none", "Found 0 soma root nodes, not 1.")]
    assert sorted((r.cell_id, r.node_id, r.parent_id) for r in ok.collect()) == [("fork", 2, -1), ("fork", 3, 2), ("fork", 5, 3), ("win", 2, -1)]
    assert trees.soma_filter(nodes)[0].filter("cell_id = 'fork'").count() == 6 and trees.soma_filter(nodes, strict=True)[0].filter("cell_id = 'fork'").count() == 5
    assert trees.largest_component(nodes).filter("cell_id = 'fork'").count() == 5
    assert [r.cell_id for r in trees.failing(nodes, F.bool_or(F.col("structure_id") == 1)).collect()] == ["none"]


def test_swc_round_trip_and_batch(spark, folder, tmp_path):
    nodes = swc.read_swc(spark, folder).filter("cell_id in ('fork', 'win')")
    swc.write_swc(nodes, f"{tmp_path}/out")
    same = trees.same_forest(materialise(nodes, "nodes"), materialise(swc.read_written(spark, f"{tmp_path}/out"), "nodes"))
    assert {r.cell_id: r.same for r in same.collect()} == {"fork": True, "win": True}

    def preprocess(nodes):
        good = trees.annotate(nodes)
        return trees.soma_filter(good.select("cell_id", "node_id", "structure_id", "x", "y", "z", "radius", "parent_id"), [1, 3])

    failed = swc.batch_preprocess(spark, folder, f"{tmp_path}/batch", preprocess, "_new")
    assert [r.cell_id for r in failed.collect()] == ["none"]
    assert {r.cell_id for r in swc.read_written(spark, f"{tmp_path}/batch").select("cell_id").distinct().collect()} == {"fork_new", "win_new"}


@pytest.mark.parametrize("share", [0.1, 0.35, 0.8])
def test_trim_cuts_the_share(spark, share):
    rng = np.random.default_rng(4)
    rows = [("c", 1, 1, 0.0, 0.0, 0.0, 1.0, -1)] + [("c", i, 3, *map(float, rng.normal(size=3) * 10), 1.0, max(1, i // 2)) for i in range(2, 60)]
    nodes = spark.createDataFrame(rows, "cell_id string, node_id long, structure_id int, x double, y double, z double, radius double, parent_id long")
    before = trees.total_length(nodes).first().total_length
    after = trees.total_length(trees.trim(nodes, [share])).first().total_length
    assert after == pytest.approx(before * (1 - share), rel=1e-6)
    assert trees.trim(nodes, [share]).exceptAll(trees.trim(nodes, [share])).count() == 0


def test_sampling(spark, folder):
    nodes = materialise(swc.read_swc(spark, folder), "nodes")
    found = {r.cell_id: r for r in sampling.sample_traces(nodes, 15).collect()}
    assert found["fork"].n == 15 and len(found["fork"].d) == 105 and len(found["fork"].points) == 15 and found["lost"].reason.startswith("node 2")
    geo = {r.cell_id: r for r in sampling.sample_traces(nodes, 8, "geodesic").collect()}
    d = pairs.square(np.array(geo["fork"].d), 8)
    assert d.max() <= 10.0 + 1e-9 and (d[:, None, :] <= d[:, :, None] + d[None] + 1e-9).all()
    flat = pairs.square(np.array({r.cell_id: r for r in sampling.sample_traces(nodes, 2).collect()}["fork"].d), 2)
    assert flat[0, 1] == 50.0  # both roots
    assert {r.cell_id for r in sampling.failures(sampling.sample_traces(nodes, 8)).collect()} == {"lost", "ring"}


def test_meshes(spark, tmp_path):
    square = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3\nf 1 3 4\n\n# x\n"
    (tmp_path / "two.obj").write_text(square + "v 5 0 0\nv 6 0 0\nv 6 1 0\nf 5 6 7\n")
    vertices, faces = tables.read_obj(spark, str(tmp_path))
    parts = {r.cell_id: r for r in sampling.sample_meshes(vertices, faces, 4, "geodesic").collect()}
    assert parts["two_0"].n == 4 and parts["two_1"].reason.startswith("3 vertices")
    whole = sampling.sample_meshes(vertices, faces, 7, "geodesic", segment=False).first()
    assert whole.n == 7 and max(whole.d) < 10
    v, f = np.array([[0, 0, 0], [1, 0, 0], [9, 0, 0], [10, 0, 0]], float), np.array([[0, 1, 0], [2, 3, 2]])
    assert sampling.connect_mesh(v, f)[-1].tolist() == [1, 2, 1]
    assert sampling.even_indices(10, 4).tolist() == [0, 3, 6, 9]


def disc(spark, radius: float = 4.0):
    rows = [("img", r, c, 7 if (r - 10) ** 2 + (c - 10) ** 2 <= radius**2 else 3 if r == 0 and c < 3 else 0, int((r - 10) ** 2 + (c - 10) ** 2 <= 2), float(r)) for r in range(21) for c in range(21)]
    return spark.createDataFrame(rows, "image_id string, r int, c int, label int, nucleus int, signal double")


def test_outlines_and_cells(spark):
    pixels = disc(spark)
    assert [(r.image_id, r.label) for r in sampling.interior_labels(pixels).collect()] == [("img", 7)]
    found = sampling.sample_outlines(pixels, 20).first()
    assert found.cell_id == "img_7" and max(found.d) == pytest.approx(9, abs=0.5)
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert sorted(len(x) for x in sampling.outlines(ring)) == [4, 20]
    cell = images.cells_of(pixels, ["signal"], n_boundary=12).first()
    assert cell.size == 49 and len(cell.boundary) == 12 and sum(cell.channels["signal"]) == pytest.approx(1) and sum(cell.nucleus) == 9
    small = images.cells_of(pixels, ["signal"], target_size=25).first()
    assert abs(small.size - 25) <= 4
    assert sampling.mask_geodesic(np.array([[0, 0], [0, 1], [1, 2]]))[0, 2] == pytest.approx(1 + 2**0.5)


def test_mapping_and_rendering(spark):
    cells = materialise(images.cells_of(disc(spark), ["signal"], n_boundary=8).unionByName(images.cells_of(disc(spark, 3.0).withColumn("image_id", F.lit("two")), ["signal"], n_boundary=8)), "cells")
    for method in ("fused", "fused_unbalanced"):
        rows = images.map_to_anchor(cells, "two_7", ["signal", "nucleus"], method=method).collect()
        assert len(rows) == 4 and all(sum(r.mass) == pytest.approx(1) and len(r.mass) == 29 for r in rows)
        own = next(r for r in rows if r.id == "two_7" and r.channel == "signal")
        assert own.dist == 0 and method or np.allclose(own.mass, cells.filter("cell_id = 'two_7'").first().channels["signal"])
    found = pipelines.signal_distances(cells, ["signal"], "two_7").first()
    assert found.dist >= 0
    image = images.render(cells.filter("cell_id = 'img_7'").first().asDict(), ["signal", "nucleus"], square=True)
    assert image.shape == (9, 9, 3) and image[..., 0].sum() == 49 and images.composite(image).shape == (9, 9, 3)
    bar = np.zeros((9, 9, 2))
    bar[1:8, 4, 0] = bar[4, 4, 1] = 1
    assert images.aligned(bar).shape[:2] in ((1, 7), (1, 8)) and abs(abs(images.major_axis(bar[..., 0])) - 90) < 1e-6
    assert images.resize_cell(bar, (18, 18)).shape == (18, 18, 2) and images.training_images(cells, "two_7", "signal", (16, 16)).count() == 2


@pytest.fixture(scope="module")
def spaces(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(24):
        p = rng.normal(size=(10, 2)) * [1, 1 + 3 * (k % 3)]
        rows.append((f"s{k:02d}", k % 3, 10, sampling.condensed(p).tolist(), [0.1] * 10, [1 + i % 4 for i in range(10)]))
    return materialise(spark.createDataFrame(rows, "id string, label int, n int, d array<double>, mass array<double>, kinds array<int>"), "spaces")


def test_pairs(spark, spaces):
    from shapespark.functions import gromov

    rows = {r.id: r.asDict() for r in spaces.collect()}
    whole = {(r["first"], r.second): r.dist for r in pairs.gw_pairwise(spaces).collect()}
    blocked = {(r["first"], r.second): r.dist for r in pairs.by_blocks(spaces, pairs.gw_kernel, pairs.GW_SCHEMA, block=5).collect()}
    assert len(whole) == 276 and whole.keys() == blocked.keys() and all(whole[k] == pytest.approx(blocked[k]) for k in whole)
    some = {(r["first"], r.second): r.dist for r in pairs.gw_query_target(spaces.filter("id < 's03'"), spaces).collect()}
    assert all(whole[tuple(sorted(k))] == pytest.approx(v) for k, v in some.items())
    plan = pairs.couplings(pairs.gw_pairwise(spaces.filter("id < 's03'"), True)).groupBy("first", "second", "i").agg(F.sum("mass").alias("m")).collect()
    assert len(plan) == 30 and all(r.m == pytest.approx(0.1) for r in plan)
    bound = {(r["first"], r.second): r.slb for r in pairs.slb_pairwise(spaces).collect()}
    native = {(r["first"], r.second): r.slb for r in pairs.slb_uniform(spaces.withColumnRenamed("id", "cell_id")).collect()}
    ranges = {(r["first"], r.second): r.slb for r in pairs.slb_weighted(spaces).collect()}
    for k, v in bound.items():
        assert native[k] == pytest.approx(v) and ranges[k] == pytest.approx(v) and v <= whole[k] + 1e-9
        assert v == pytest.approx(gromov.slb(*(pairs.space_of(rows[n]) for n in k)))
    q = pairs.qgw_pairwise(spaces, 5)
    same = q.join(pairs.qgw_pairwise(spaces, 5, q.select("first", "second")).withColumnRenamed("dist", "again"), ["first", "second"])
    assert same.count() == 276 and same.filter("abs(dist - again) > 1e-9").count() == 0
    assert pairs.fused_pairwise(spaces.filter("id < 's04'"), pairs.kind_penalties(1, 1), 0.1).count() == 6
    assert pairs.penalty_scale(spaces, pairs.kind_penalties(1, 1), 20) > 0
    assert pairs.unbalanced_pairwise(spaces.filter("id < 's04'"), 0.8, 0.5, sample=4).filter("value >= 0").count() == 6
    upper, anchors = pairs.anchored(spaces, 3, "s00", lambda a, b: pairs.gw_query_target(a, b).select("first", "second", "dist"))
    assert len(set(anchors)) == 3 and upper.count() == 276


def test_adaptive_recall(spark, spaces):
    found = materialise(adaptive.adaptive_neighbours(spaces, 10, 0.97, 3, per_bin=5), "adaptive")
    exact = {(r["first"], r.second) for r in pairs.nearest(pairs.qgw_pairwise(spaces, 10), 3).collect()}
    got = {(r["first"], r.second) for r in pairs.nearest(found, 3).collect()}
    assert found.count() == 276 and len(exact & got) >= 0.9 * len(exact)


def test_graphs(spark, spaces):
    dist = materialise(pairs.gw_pairwise(spaces).select("first", "second", "dist"), "dist")
    assert graphs.medoid(dist).count() == 1 and graphs.knn_graph(dist, 3).filter("first = second").count() == 0
    for labels in (graphs.louvain(dist, 6), graphs.leiden(dist, 6), graphs.leiden(dist, 6, 0.1)):
        assert labels.count() == 24
    assert sum(r.share for r in graphs.cluster_shares(graphs.leiden(dist, 6)).collect()) == pytest.approx(1)
    icdm = spaces.filter("id < 's05'").withColumnRenamed("id", "cell_id").select("cell_id", "n", "d")
    coupling = pairs.couplings(pairs.gw_pairwise(spaces.filter("id < 's05'"), True))
    average = materialise(graphs.average_shape(icdm, coupling, "s02"), "average")
    assert average.count() == 100 and average.filter("capped > plain + 1e-9 or (i = j and plain <> 0)").count() == 0
    assert graphs.shape_tree(average, 3).filter("parent = -1").count() >= 1
    x, y = graphs.cloud_heatmap(np.random.default_rng(0).normal(size=(40, 2)), 6, np.random.default_rng(1).normal(size=(30, 2)), 5)
    assert len(x) == 40 and len(y) == 30


def test_statistics(spark, spaces):
    dist = materialise(pairs.gw_pairwise(spaces).select("first", "second", "dist"), "dist")
    eps = dist.agg(F.percentile("dist", 0.3)).first()[0]
    label = spaces.select(F.col("id").alias("obj"), F.explode(F.array(*[F.struct(F.lit(f"l{k}").alias("name"), (F.col("label") == k).cast("double").alias("value")) for k in range(3)])).alias("f")).select("obj", "f.*")
    scores = {r.name: r.score for r in statistics.laplacian_scores(label, dist, eps).collect()}
    perms = materialise(statistics.permuted_scores(label, dist, eps, 200), "perms")
    assert {r.name: pytest.approx(r.score) for r in perms.filter("perm = 0").collect()} == scores
    found = {r.name: r for r in statistics.association(label, dist, eps, 200).collect()}
    assert min(r.p for r in found.values()) < 0.1 and all(r.q >= r.p for r in found.values())
    cov = spaces.select(F.col("id").alias("obj"), F.lit("c").alias("name"), F.element_at("d", 1).alias("value"))
    with_cov = statistics.association(label, dist, eps, 200, cov).collect()
    assert len(with_cov) == 3 and all(0 <= r.f_p <= 1 and 0 < r.p_adjusted <= 1 for r in with_cov)
    with pytest.raises(Exception, match="constant feature"):
        statistics.laplacian_scores(label.withColumn("value", F.lit(1.0)), dist, eps).collect()
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.04), (4, 0.5)], "k int, p double")
    assert [r.q for r in statistics.q_values(p).orderBy("k").collect()] == pytest.approx([0.04, 0.064, 0.064, 0.5])
    assert [r.q for r in statistics.q_values(p, step_up=True).orderBy("k").collect()] == pytest.approx([0.04, 0.064, 0.064, 0.5])
    x = np.random.default_rng(0).normal(size=(50, 2))
    assert statistics.gaussian_density(x, x).min() > 0
    emb = statistics.modality_of(dist.toPandas(), 2, 5)
    assert len(emb) == 24 and len(emb.vector[0]) == 2


def test_weighted_neighbours_against_numpy(spark):
    rng = np.random.default_rng(5)
    mods = [rng.normal(size=(30, 4)), rng.normal(size=(30, 3))]
    rows = [(m, f"o{i:02d}", v.tolist()) for m, x in enumerate(mods) for i, v in enumerate(x)]
    found = {(r["first"], r.second): r.similarity for r in statistics.weighted_neighbours(spark.createDataFrame(rows, "modality int, obj string, vector array<double>"), 5).collect()}
    d = [np.linalg.norm(x[:, None] - x[None], axis=2) for x in mods]
    near = [np.argsort(x + np.where(np.eye(30), -1, 0), axis=1, kind="stable") for x in d]
    nn = [x[np.arange(30), o[:, 1]] for x, o in zip(d, near, strict=True)]
    bw = [np.array([np.delete(x[i], i)[:20].mean() for i in range(30)]) for x in d]
    kernel = lambda v, m: np.exp(-np.maximum(v - nn[m], 0) / (bw[m] - nn[m]))
    aff = [[kernel(np.linalg.norm(mods[t][near[s][:, 1:6]].mean(axis=1) - mods[t], axis=1), t) for t in range(2)] for s in range(2)]
    ratio = np.stack([aff[0][0] / (aff[0][1] + 1e-4), aff[1][1] / (aff[1][0] + 1e-4)])
    weight = np.exp(ratio - ratio.max(axis=0))
    weight /= weight.sum(axis=0)
    want = sum(weight[m][:, None] * np.exp(-np.maximum(d[m] - nn[m][:, None], 0) / (bw[m] - nn[m])[:, None]) for m in range(2))
    assert all(v == pytest.approx(min(1, want[int(a[1:]), int(b[1:])])) for (a, b), v in found.items()) and len(found) == 870


def test_columns_and_tables(spark, spaces, tmp_path):
    assert tables.icdm_width(["cell_id", "d_0_1", "d_0_2", "d_1_2"]) == 3
    for bad in (["id", "x"], ["cell_id", "a", "b"]):
        with pytest.raises(ValueError):
            tables.icdm_width(bad)
    dist = spark.createDataFrame([("b", "a", 1.0), ("a", "c", 2.0), ("c", "b", 3.0)], "first string, second string, dist double")
    canon = materialise(tables.canonical(dist, "first", "second", "dist"), "canon")
    assert columns.gather(canon).first().d == [1.0, 2.0, 3.0] and columns.gather(canon, ["c", "a", "b"]).first().d == [2.0, 3.0, 1.0]
    with pytest.raises(Exception, match="two names become"):
        columns.rename(canon, lambda c: F.lit("x")).collect()
    tables.write_couplings(spark.createDataFrame([("b", "a", 1, 2, 0.5)], "first string, second string, i int, j int, mass double"), f"{tmp_path}/c")
    assert tuple(tables.read_couplings(spark, f"{tmp_path}/c").first()) == ("a", "b", 2, 1, 0.5)
    tables.write_settings(f"{tmp_path}/image_settings.json", shape=[64, 64])
    assert tables.read_settings(str(tmp_path)) == {"shape": [64, 64]} and tables.read_settings(f"{tmp_path}/none") is None
    x = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.2, 0.3, 0.5)], "x double, y double, z double")
    flat = x.select(*[c.alias(n) for n, c in zip("uv", columns.plane(F.col("x"), F.col("y"), F.col("z")), strict=True)]).toPandas().to_numpy()
    full = x.toPandas().to_numpy()
    assert np.allclose(np.linalg.norm(flat[:, None] - flat[None], axis=2), np.linalg.norm(full[:, None] - full[None], axis=2))
    sorted_ = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],), ([],), ([1.0],)], "a array<double>").select(columns.is_sorted(F.col("a")).alias("ok"))
    assert [r.ok for r in sorted_.collect()] == [True, False, True, True]


def test_pipelines(spark, folder, tmp_path):
    failed = pipelines.traces_to_icdm(spark, folder, f"{tmp_path}/t", 5)
    assert {r.cell_id for r in failed.collect()} == {"lost", "ring"}
    assert pipelines.gw_matrix(spark, f"{tmp_path}/t/icdm", f"{tmp_path}/gw", f"{tmp_path}/plans").count() == 3
    assert tables.read_distances(spark, f"{tmp_path}/gw").count() == 3 and tables.read_couplings(spark, f"{tmp_path}/plans").count() == 15
    pipelines.slb_matrix(spark, f"{tmp_path}/t/icdm", f"{tmp_path}/slb")
    pipelines.qgw_matrix(spark, f"{tmp_path}/t/icdm", 3, f"{tmp_path}/qgw")
    assert spark.read.csv(f"{tmp_path}/qgw", header=True).count() == 3
    assert pipelines.gw_matrix_query_target(spark, f"{tmp_path}/t/icdm", f"{tmp_path}/t/icdm", f"{tmp_path}/qt").count() == 6
    fused = pipelines.fused_matrix(spark, f"{tmp_path}/t/icdm", spark.read.parquet(f"{tmp_path}/t/types"), f"{tmp_path}/fused", 1.0, 1.0)
    assert fused.count() == 3
    only = tmp_path / "only"
    only.mkdir()
    (only / "fork.swc").write_text(FORK)
    assert pipelines.partial_matching(spark, str(only), 1, 5, [0.1, 0.2], f"{tmp_path}/pm").count() == 1


def test_arrivals(spark, spaces, tmp_path):
    inbox = f"{tmp_path}/inbox"
    columns_ = spaces.select("id", "n", "d", "mass")
    columns_.filter("id < 's03'").coalesce(1).write.parquet(inbox)
    stream = lambda: spark.readStream.schema(columns_.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    compare_arrivals(stream(), f"{tmp_path}/known", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    columns_.filter("id >= 's03' and id < 's05'").coalesce(1).write.mode("append").parquet(inbox)
    compare_arrivals(stream(), f"{tmp_path}/known", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.select("first", "second").distinct().count() == found.count() == 10


def test_splits(spark):
    ids = spark.range(60).select(F.format_string("%03d", "id").alias("id"))
    found = pairs.split_pairs(ids, 90, {"train": 0.7, "test": 0.3}, seed=3)
    rows = found.collect()
    assert len({(r["first"], r.second) for r in rows}) == len(rows)
    by = pd.DataFrame([(r.part, x) for r in rows for x in (r["first"], r.second)], columns=["part", "id"]).groupby("id").part.nunique()
    assert (by == 1).all()
