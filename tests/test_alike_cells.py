"""Cells that are the same are mapped and compared once, and every pair of them is there."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapespark.functions.transport import emd_cost
from shapespark.operators import images, pairs


def test_alike_distributions_are_compared_once(spark, tmp_path, monkeypatch):
    ground = np.abs(np.subtract.outer(np.arange(3), np.arange(3))).astype(float)
    masses = [[0.2, 0.3, 0.5], [0.5, 0.5, 0.0], [0.1, 0.1, 0.8]]
    rows = [(f"{k:03d}", channel, masses[k % 3]) for k in range(30) for channel in "ab"]
    log = tmp_path / "solved"
    log.touch()

    def logged(a, b, cost):
        with log.open("a") as f:
            f.write("x")
        return emd_cost(a, b, cost)

    monkeypatch.setattr("shapespark.functions.transport.emd_cost", logged)
    found = pairs.mapped_distances(ground, spark.createDataFrame(rows, "id string, channel string, mass array<double>")).collect()
    assert log.stat().st_size == 2 * 6  # three and themselves, for each channel
    assert len({r[:3] for r in found}) == len(found) == 2 * 435
    for r in found:
        assert r.dist == pytest.approx(emd_cost(np.array(masses[int(r.first) % 3]), np.array(masses[int(r.second) % 3]), ground), abs=1e-12)


def test_alike_cells_are_mapped_once(spark, tmp_path, monkeypatch):
    grid = [("i", r, 10 * k + c, k + 1, int(r == 1), float(r + (k % 2) * c)) for k in range(8) for r in range(3) for c in range(3)]
    pixels = spark.createDataFrame(grid, "image_id string, r int, c int, label int, nucleus int, signal double")
    cells = images.cells_of(pixels, ["signal"], n_boundary=8, border=False).localCheckpoint()
    row = {r.cell_id: r.asDict() for r in cells.collect()}
    log, single = tmp_path / "mapped", images.map_cell
    log.touch()

    def logged(*args, **options):
        with log.open("a") as f:
            f.write("x")
        return single(*args, **options)

    monkeypatch.setattr(images, "map_cell", logged)
    found = images.map_to_anchor(cells, "i_1", ["signal"]).orderBy("id").collect()
    assert log.stat().st_size == 3  # the anchor, its copies, and the others
    assert [r.id for r in found] == sorted(row)
    for r in found:
        dist, mapped = single(row[r.id], row["i_1"], ["signal"])
        assert r.dist == pytest.approx(dist) and r.mass == pytest.approx(mapped["signal"].tolist())
    assert images.map_to_anchor(cells, "i_1", ["nucleus"]).filter(F.col("channel") == "nucleus").count() == 8
