"""How often rows are sent to meet each other, and the parts that kernels get of large blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shapespark.operators import pairs, statistics


def test_rows_are_sent_so_often_at_most():
    for rows in (10_256, 102_564, 400_000):
        assert pairs.block_count(rows, 64, 136, 6) <= pairs.MOST_SENT + 1
    # few rows keep small blocks, many cores get enough, and a block stays within a task's memory
    assert pairs.block_count(500, 64, 136, 6) == 8 and pairs.block_count(102_564, 64, 136, 78) == 78
    assert pairs.block_count(100_000, 64, 500_000, 6) == 1563 and pairs.block_count(10_256, 64, None, 6) == 161


def test_parts_of_blocks_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_SENT", 2)
    n, m = 90, 25
    rows = spark.range(n).select(F.format_string("s%03d", "id").alias("id"), F.array(F.col("id").cast("double")).alias("d"), F.array(F.lit(1.0)).alias("mass"))
    monkeypatch.setattr(pairs, "FEW_ROWS", 1000)

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        i, j = np.triu_indices(len(a), 1) if b is None else (np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)))
        x, y = a.id.to_numpy()[i], (a if b is None else b).id.to_numpy()[j]
        return pd.DataFrame({"first": x, "second": y, "most": max(len(a), 0 if b is None else len(b))})

    schema = "first string, second string, most int"
    enough = spark.sparkContext.defaultParallelism
    found = pairs.by_blocks(rows, kernel, schema, block=4, numbers=pairs.NUMBERS).collect()
    sent = pairs.block_count(n, 4, 2, int(np.ceil(np.sqrt(6 * enough))))
    assert sent < n // 4  # so blocks are larger than what a kernel takes
    assert len(found) == n * (n - 1) // 2 == len({frozenset((r["first"], r.second)) for r in found})
    assert max(r.most for r in found) <= 5
    across = pairs.by_blocks(rows, kernel, schema, rows.limit(m), block=4, numbers=pairs.NUMBERS).collect()
    assert len(across) == n * m == len({(r["first"], r.second) for r in across}) and max(r.most for r in across) <= 5


def test_predictions_are_sent_as_vectors(spark):
    rows = [(m, f"o{k}", [float(k * (m + 2) + d) for d in range(3 - m)]) for m in range(2) for k in range(4)]
    vectors = spark.createDataFrame(rows, "modality int, obj string, vector array<double>")
    near = spark.createDataFrame([(m, f"o{k}", f"o{(k + step) % 4}") for m in range(2) for k in range(4) for step in (1, 2)], "modality int, first string, second string")
    scale = spark.createDataFrame([(m, f"o{k}", 3.0, 1.0) for m in range(2) for k in range(4)], "modality int, obj string, bandwidth double, nearest double")
    found = statistics.affinities(vectors, near, scale)
    # before, each number of a vector was a row of its own
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    values = {(m, o): np.array(v) for m, o, v in rows}
    got = {(r.source, r.target, r.obj): r.affinity for r in found.collect()}
    for s in range(2):
        for t in range(2):
            for k in range(4):
                guess = np.mean([values[t, f"o{(k + step) % 4}"] for step in (1, 2)], axis=0)
                away = np.linalg.norm(guess - values[t, f"o{k}"])
                assert abs(got[s, t, f"o{k}"] - np.exp(-max(away - 1.0, 0.0) / 2.0)) < 1e-12
    assert len(got) == 16
