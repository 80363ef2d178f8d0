"""Toxicity against a plain run of the transducers, one after another, word by word."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shapespark.llm import toxicity

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)


def plain_clauses(text: str, lexicon: dict[str, float]) -> tuple[list[float], int]:
    """Scores of the clauses that have a match, and the number of words: each mark is looked for on its own, backwards from the match."""
    kinds = {w: k for k, names in ((TARGET, toxicity.WORDS[toxicity.TARGET]), (NEGATION, toxicity.WORDS[toxicity.NEGATION]), (REPORT, toxicity.WORDS[toxicity.REPORT]), (THREAT, toxicity.WORDS[toxicity.THREAT])) for w in names.split()}
    out, count = [], 0
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        count += len(words)
        read = []
        for w in words:
            weight = max(lexicon.get(a, 0.0) for a in [w + "$", *(w[:n] for n in range(4, min(len(w), 10) + 1))])
            read.append((INSULT, weight) if weight > 0 else (kinds.get(w, OTHER), 2.0))
        within = lambda i, kind, reach: any(read[j][0] == kind for j in range(max(0, i - reach), i))  # noqa: E731, B023
        scores = []
        for i, (kind, weight) in enumerate(read):
            aimed = within(i, TARGET, 5)
            if kind == INSULT or kind == THREAT and aimed:
                scores.append(weight * (0.3 if within(i, NEGATION, 3) else 1) * (0.5 if within(i, REPORT, len(read)) else 1) * (1.5 if aimed else 1))
        if scores:
            out.append(sum(scores))
    return out, count


def test_clauses_against_plain_version():
    lexicon = {"idiot$": 5.0, "scum": 4.0, "fool$": 1.5, "stup": 2.5}
    model = toxicity.Model(lexicon)
    r = random.Random(4)
    vocabulary = [w for v in toxicity.WORDS.values() for w in v.split()][::3] + ["idiot", "idiots", "scumbag", "fool", "foolish", "stupid", "the", "a", "lamp", "of", "x1y", "É", ".", "!", ";", "\n", ",", "?"] * 4
    for _ in range(600):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))
        found, words = model.clauses(text)
        want, count = plain_clauses(text, lexicon)
        assert words == count and [toxicity.clause_score(c) for c in found] == pytest.approx(want)
        total, strong = sum(want), [s for s in want if s > 3]
        assert model.features(text) == pytest.approx([math.log1p(total), 10 * total / (count + 20), max(want, default=0.0), math.log1p(len(want)), math.log1p(count), 10 * len(strong) / (count + 20), math.log1p(len(strong)), float(not count), 1.0])


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(200)] + [(None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "v", "w") for i in range(10)] * 3 + [(None, 1, "v", "w"), (3, None, "v", "w"), (4, 5, "v", "w")], "doc_id long, toxic int, text string, h string")
    rows = toxicity.training_texts(docs, labels, 100)
    assert rows.count() == 5 - sum(1 for i in range(5) if spark.range(1).select(F.lit(i).alias("doc_id")).filter(toxicity.held_out()).count())
    assert toxicity.training_texts(docs, labels, 2).count() <= 2


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0
