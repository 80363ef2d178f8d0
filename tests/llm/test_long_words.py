"""Merge rounds against the library, on long words and on pieces whose merges see each other."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from shapespark.llm import piece_bpe  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    return piece_bpe.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(models, texts: list[str]) -> None:
    own, library = models
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def test_words_of_unsafe_pieces(models):
    own = models[0]
    r = random.Random(8)
    unsafe = [own.text[i] for i in np.flatnonzero(own.unsafe) if own.kind[i] == piece_bpe.NORMAL]
    every = [t for t in own.id if len(t) > 1]
    texts = []
    for _ in range(400):
        source = r.choice((unsafe, every))
        unit = "".join(r.choice(source)[: r.randint(1, 9)] for _ in range(r.randint(1, 4)))
        texts.append(unit * (1500 // len(unit)) if r.random() < 0.6 else "".join(r.choice(source) for _ in range(r.randint(1, 300))))
    same(models, texts)


@pytest.mark.parametrize("n", [*range(1, 70), 1000, 1001, 100_000])
def test_runs_of_one_symbol(models, n):
    same(models, [f"x{c * n}y{c * (n // 3)}" for c in " ▁-=a/" if n < 1000 or c in " -"])


def test_long_words_take_linear_time(models):
    r = random.Random(2)
    for make in (lambda n: " " * n, lambda n: base64.b64encode(r.randbytes(n)).decode(), lambda n: "the" * n, lambda n: "".join(r.choices("etaoin", k=n))):
        took = []
        for n in (20_000, 200_000):
            text = make(n)
            began = time.perf_counter()
            models[0].encode([text])
            took.append(time.perf_counter() - began)
            models[0].known.clear()
            same(models, [text])
        assert took[1] < 40 * max(took[0], 0.02)
