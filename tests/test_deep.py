"""The learned surrogate."""

from __future__ import annotations

import numpy as np
import pytest

from shapespark.deep import surrogate

rng = np.random.default_rng(0)


def data(n: int = 24) -> tuple[np.ndarray, ...]:
    x1, x2 = rng.random((n, 12)), rng.random((n, 12))
    t1, t2 = (x[:, :6] / x[:, :6].sum(axis=1, keepdims=True) for x in (x1, x2))
    return x1, x2, t1, t2, ((x1 - x2) ** 2).sum(axis=1)


def test_gradients_against_differences():
    model, d = surrogate.Surrogate(12, 6, 4, 5), data(8)
    grads, _ = model.gradients(*d, sparsity=0.3)
    for name, place in (("w1", (3, 2)), ("b1", (1,)), ("w2", (2, 1)), ("b2", (0,)), ("w3", (1, 4)), ("b3", (2,))):
        w, ends = model.weights[name], []
        for step in (1e-5, -2e-5):
            w[place] += step
            ends.append(model.gradients(*d, sparsity=0.3)[1])
        w[place] += 1e-5
        assert grads[name][place] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_training_improves_and_saves(spark, tmp_path):
    model, d = surrogate.Surrogate(12, 6, 4, 16), data(120)
    losses = surrogate.train(model, d, data(40), epochs=40, batch=20, rate=0.01)
    before = surrogate.Surrogate(12, 6, 4, 16).gradients(*d)[1]
    assert model.gradients(*d)[1] < 0.7 * before
    model.save(f"{tmp_path}/m.json")
    again = surrogate.load(f"{tmp_path}/m.json")
    assert np.allclose(again.embed(d[0]), model.embed(d[0]))
    images = spark.createDataFrame([(f"c{i}", d[0][i].tolist(), d[2][i].tolist()) for i in range(5)], "cell_id string, image array<double>, target array<double>")
    dist = surrogate.predict_distances(again, images).collect()
    assert len(dist) == 10 and dist[0].dist == pytest.approx(model.forward(d[0][[int(dist[0]["first"][1:])]], d[0][[int(dist[0].second[1:])]])[0][0])
    assert all(sum(r.mapped) == pytest.approx(1) for r in surrogate.map_to_anchor(model, images).collect())
    pairs = spark.createDataFrame([("c0", "c1", 1.0)], "first string, second string, dist double")
    assert surrogate.paired(images, pairs).count() == 1 and surrogate.augmented(images, 3).count() == 15


def test_losses():
    p = np.array([[0.5, 0.5]])
    assert surrogate.divergence_loss(p, p) == 0 and surrogate.reconstruction_loss(p, p) > 0
    assert surrogate.sparsity_loss(np.full((3, 2), np.log(0.1 / 0.9)), 0.1) == pytest.approx(0, abs=1e-12)
    assert surrogate.widened(np.ones((8, 8, 2)), 0.5, 0.5, rng)[..., 0].sum() == 32
