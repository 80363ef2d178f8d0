"""A network that predicts the distance of two cells' signals, and the mapped signal, from their images alone.

An encoder turns an image into an embedding; the squared distance of two embeddings predicts the distance of the cells, and a decoder turns an
embedding into a distribution over the anchor's pixels. The convolutional backbones that such networks use elsewhere need libraries that aren't
here; this one is a perceptron of one hidden layer on images of one size, trained by Adam. Training data are a bounded sample and fit the
driver; inference runs over DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8


def divergence_loss(true: np.ndarray, guess: np.ndarray) -> float:
    """Mean over rows of sum y ln(y / p), both clamped to [1e-8, 1]."""
    y, p = np.clip(true, FLOOR, 1), np.clip(guess, FLOOR, 1)
    return float((y * np.log(y / p)).sum(axis=-1).mean())


def sparsity_loss(embeddings: np.ndarray, target: float = 0.1) -> float:
    """Divergence of the mean activation of each unit, by a sigmoid, from a target."""
    mean = np.clip(1 / (1 + np.exp(-embeddings)), FLOOR, 1 - FLOOR).mean(axis=0)
    return float((target * np.log(target / mean) + (1 - target) * np.log((1 - target) / (1 - mean))).sum())


def reconstruction_loss(true: np.ndarray, guess: np.ndarray) -> float:
    """Divergence and twice the binary cross-entropy."""
    p = np.clip(guess, FLOOR, 1 - FLOOR)
    return divergence_loss(true, guess) + 2 * float(-(true * np.log(p) + (1 - true) * np.log(1 - p)).mean())


def widened(image: np.ndarray, low: float, high: float, rng: np.random.Generator) -> np.ndarray:
    """An image (height, width, channels) resampled to a random share of its width, in the middle of the same frame."""
    from ..operators.images import pad_to, resize_cell

    width = max(1, min(image.shape[1], round(image.shape[1] * rng.uniform(low, high))))
    return pad_to(resize_cell(image, (image.shape[0], width)), image.shape)


def augmented(images: DataFrame, copies: int) -> DataFrame:
    """Each row as often as copies says, numbered."""
    return images.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))


def paired(images: DataFrame, distances: DataFrame) -> DataFrame:
    """(first, second, image1, image2, target1, target2, dist) from images (cell_id, image, target) and distances (first, second, dist)."""
    a, b = (images.select(F.col("cell_id").alias(n), F.col("image").alias(f"image{k}"), F.col("target").alias(f"target{k}")) for k, n in ((1, "first"), (2, "second")))
    return distances.select("first", "second", "dist").join(a, "first").join(b, "second")


@dataclass
class Surrogate:
    """Weights of encoder (input, hidden, embedding) and decoder (embedding, pixels)."""

    size: int
    pixels: int
    embedding: int = 50
    hidden: int = 64
    seed: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            shapes = {"w1": (self.size, self.hidden), "w2": (self.hidden, self.embedding), "w3": (self.embedding, self.pixels)}
            self.weights = {k: rng.normal(size=s) / np.sqrt(s[0]) for k, s in shapes.items()} | {"b1": np.zeros(self.hidden), "b2": np.zeros(self.embedding), "b3": np.zeros(self.pixels)}

    def embed(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(x @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]

    def decode(self, e: np.ndarray) -> np.ndarray:
        z = e @ self.weights["w3"] + self.weights["b3"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def forward(self, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared distances of embeddings, and both reconstructions."""
        e1, e2 = self.embed(x1), self.embed(x2)
        return ((e1 - e2) ** 2).sum(axis=1), self.decode(e1), self.decode(e2)

    def gradients(self, x1, x2, t1, t2, dist, dist_weight: float = 1.0, sparsity: float = 0.0, target: float = 0.05) -> tuple[dict[str, np.ndarray], float]:
        """Of dist_weight * mean squared error of distances + divergence of both reconstructions (+ sparsity)."""
        w, n = self.weights, len(x1)
        x, t = np.concatenate([x1, x2]), np.concatenate([t1, t2])
        pre = x @ w["w1"] + w["b1"]
        h = np.maximum(pre, 0)
        e = h @ w["w2"] + w["b2"]
        gap = e[:n] - e[n:]
        error = (gap**2).sum(axis=1) - dist
        guess = self.decode(e)
        loss = dist_weight * float((error**2).mean()) + 2 * divergence_loss(t, guess)
        d3 = (guess * t.sum(axis=1, keepdims=True) - t) / n
        de = d3 @ w["w3"].T
        push = dist_weight * 4 * error[:, None] * gap / n
        de[:n] += push
        de[n:] -= push
        if sparsity:
            loss += sparsity * sparsity_loss(e, target)
            s = 1 / (1 + np.exp(-e))
            mean = np.clip(s.mean(axis=0), FLOOR, 1 - FLOOR)
            de += sparsity * ((1 - target) / (1 - mean) - target / mean) * s * (1 - s) / len(e)
        dh = (de @ w["w2"].T) * (pre > 0)
        return {"w1": x.T @ dh, "b1": dh.sum(axis=0), "w2": h.T @ de, "b2": de.sum(axis=0), "w3": e.T @ d3, "b3": d3.sum(axis=0)}, loss

    def save(self, path: str) -> None:
        meta = {"size": self.size, "pixels": self.pixels, "embedding": self.embedding, "hidden": self.hidden}
        Path(path).write_text(json.dumps(meta | {"weights": {k: v.tolist() for k, v in self.weights.items()}}))


def load(path: str) -> Surrogate:
    data = json.loads(Path(path).read_text())
    return Surrogate(data["size"], data["pixels"], data["embedding"], data["hidden"], weights={k: np.array(v) for k, v in data["weights"].items()})


def train(model: Surrogate, data: tuple[np.ndarray, ...], valid: tuple[np.ndarray, ...] | None = None, epochs: int = 100, batch: int = 100, rate: float = 1e-3, decay: float = 0.95, weight_decay: float = 1e-5, patience: int = 3, seed: int = 0, **loss) -> list[float]:
    """Adam on (image1, image2, target1, target2, dist), with a falling rate; ends when the validation loss hasn't improved for `patience` epochs,
    with the best weights. Pretraining is the same with dist_weight 0. Returns the validation (or training) losses."""
    rng, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
    best, kept, waited = np.inf, {k: w.copy() for k, w in model.weights.items()}, 0
    for epoch in range(epochs):
        order, total = rng.permutation(len(data[0])), 0.0
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            grads, value = model.gradients(*(d[rows] for d in data), **loss)
            total += value * len(rows) / len(order)
            step += 1
            for k, g in grads.items():
                g = g + weight_decay * model.weights[k]
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                model.weights[k] -= rate * decay**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        losses.append(model.gradients(*valid, **loss)[1] if valid is not None else total)
        if losses[-1] < best - 1e-9:
            best, kept, waited = losses[-1], {k: w.copy() for k, w in model.weights.items()}, 0
        else:
            waited += 1
            if waited >= patience:
                break
    model.weights = kept
    return losses


def _applied(images: DataFrame, use: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = use(np.stack(batch.image.to_list())) if len(batch) else np.empty((0, 1))
            yield pd.DataFrame({"cell_id": batch.cell_id, name: values.tolist()})

    return images.select("cell_id", "image").mapInPandas(each, f"cell_id string, {name} array<double>")


def extract_embeddings(model: Surrogate, images: DataFrame) -> DataFrame:
    """(cell_id, embedding) of images (cell_id, image)."""
    return _applied(images, model.embed, "embedding")


def map_to_anchor(model: Surrogate, images: DataFrame) -> DataFrame:
    """(cell_id, mapped): predicted distributions on the anchor's pixels."""
    return _applied(images, lambda x: model.decode(model.embed(x)), "mapped")


def predict_distances(model: Surrogate, images: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(first, second, dist) of all pairs, or of the given ones."""
    from ..operators.pairs import embedding_distances
    from ..storage import materialise

    found = materialise(extract_embeddings(model, images), "embeddings")
    return embedding_distances(found.select(F.col("cell_id").alias("id"), F.col("embedding").alias("vector")), pairs)
