"""Toxicity by a weighted grammar of finite-state transducers.

Words are read by a weighted acceptor whose arcs (whole words and stems) are learned from labelled texts: an arc weighs the log ratio of its
rates in toxic and in other texts. The resulting symbols of each clause run through a composition of transducers: one marks insults and
threats in the scope of a negation, one those after reported speech, one those aimed at somebody, and one drops threats that are aimed at
nobody. Each mark has a weight that multiplies that of its match (MARK_WEIGHTS). A clause scores the sum of its weighted matches, and the
features of a text, from which a logistic model fitted to the same texts makes the score, are taken from the scores of its clauses alone.

The lexicon and the model are fitted to TRAINING_ROWS labelled rows at most, in the order of a hash of doc_id, of which no row has a
crc32(doc_id) that leaves 2 modulo 4. Their number doesn't grow with the corpus; every text is scored whole.

Defined cases: a null or empty text has no matches and gets the model's score for that; a very long text is read whole, clause by clause; of a
word's arcs the heaviest counts, and arcs of one weight are ranked by name; a null doc_id is scored and not held out; rows that
share a doc_id each get a row; labels without a toxic value or a text aren't used; without any labels of both classes nothing is learned, and
scores rest on the seed lexicon; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, materialise, table

TRAINING_ROWS, LEXICON_ARCS = 12_000, 20_000
LIMIT = 0.3
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
BREAKS = frozenset(".!?;\n")
SHORTEST_STEM, LONGEST_STEM = 4, 10
#: An arc counts if so many toxic training texts have it and its weight reaches the least.
LEAST_TEXTS, LEAST_WEIGHT = 6, 1.2
REMEMBERED = 300_000

OTHER, TARGET, NEGATION, REPORT = range(4)
#: Insults and threats take 8 symbols each: bit 0 negated, bit 1 reported, bit 2 aimed.
INSULT, THREAT, SYMBOLS = 4, 12, 20
NEGATED, REPORTED, AIMED = 1, 2, 4
#: What a mark makes of a match's weight: denied and reported insults count less, those aimed at somebody more.
MARK_WEIGHTS = {NEGATED: 0.3, REPORTED: 0.5, AIMED: 1.5}
FACTORS = [math.prod(w for m, w in MARK_WEIGHTS.items() if marks & m) for marks in range(8)]
# fixed values: function words of English, German, French and Spanish
WORDS = {
    TARGET: "you your yours u he she they them him her people everyone du dich dir ihr euch sie tu toi vous te vos lui ils elles usted ustedes tú ti vosotros",
    NEGATION: "not no never neither nor isnt arent without nicht kein keine nie niemals ne pas jamais sans non nunca jamás sin ni",
    REPORT: "said says say wrote writes quoted quote called claimed alleged reported according sagte sagt schrieb zitierte behauptete dit disait écrit selon prétend dijo dice escribió según afirma",
    THREAT: "kill killing destroy hurt beat stab shoot burn punish töten umbringen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar",
}
SEEDS = {w: k for k, v in WORDS.items() for w in v.split()}
THREAT_WEIGHT = 2.0


@dataclass(frozen=True)
class Transducer:
    """step(state, symbol) gives the next state and the symbol that comes out; state 0 is the first, and clauses start there."""

    states: int
    step: Callable[[int, int], tuple[int, int]]


def _marking(trigger: int, mark: int, scope: int, lasting: bool = False) -> Transducer:
    """Marks insults and threats that come within `scope` words after a trigger, or anywhere after it."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == trigger:
            return scope, symbol
        out = symbol | 0
        if symbol >= INSULT and state:
            base = INSULT if symbol < THREAT else THREAT
            out = base + ((symbol - base) | mark)
        return (state if lasting else max(0, state - 1)), out

    return Transducer(scope + 1, step)


NEGATING = _marking(NEGATION, NEGATED, 3)
REPORTING = _marking(REPORT, REPORTED, 1, lasting=True)
AIMING = _marking(TARGET, AIMED, 5)
THREATENING = Transducer(1, lambda state, symbol: (0, OTHER if symbol >= THREAT and not (symbol - THREAT) & AIMED else symbol))


def compose(*machines: Transducer) -> list[list[tuple[int, int]]]:
    """The table [state][symbol] of a chain of transducers, each reading what the one before puts out; reachable states only."""
    number, table, queue = {(0,) * len(machines): 0}, [], [(0,) * len(machines)]
    for states in queue:
        row = []
        for symbol in range(SYMBOLS):
            new, out = [], symbol
            for machine, state in zip(machines, states, strict=True):
                state, out = machine.step(state, out)
                new.append(state)
            key = tuple(new)
            if key not in number:
                number[key] = len(number)
                queue.append(key)
            row.append((number[key], out))
        table.append(row)
    return table


GRAMMAR = compose(NEGATING, REPORTING, AIMING, THREATENING)


def arcs(word: str) -> Iterator[str]:
    """The word as a whole ($ at its end) and its stems."""
    yield word + "$"
    for n in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1):
        yield word[:n]


FEATURES = 9
#: A clause that scores more is a strong one.
STRONG = 3.0


def clause_score(matches: list[tuple[int, float]]) -> float:
    """The sum of a clause's matches, each weighed by its marks."""
    return sum(weight * FACTORS[symbol - (INSULT if symbol < THREAT else THREAT)] for symbol, weight in matches)


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.array([4.0] + [0.0] * (FEATURES - 2) + [-4.0]))
    memory: dict[str, tuple[int, float]] = field(default_factory=dict)

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.memory.get(word)
        if found is None:
            weight = max((self.lexicon.get(a, 0.0) for a in arcs(word)), default=0.0)
            kind = SEEDS.get(word, OTHER)
            found = (INSULT, weight) if weight > 0 else (kind, THREAT_WEIGHT if kind == THREAT else 0.0)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = found
        return found

    def clauses(self, text: str) -> tuple[list[list[tuple[int, float]]], int]:
        """The matches (symbol, weight) of each clause that has any, and the number of words."""
        tokens = TOKEN.findall(text.lower())
        read = list(map(self.symbol, tokens))
        words = len(tokens) - sum(map(tokens.count, BREAKS))
        out, done = [], -1
        for i in (i for i, (s, _) in enumerate(read) if s >= INSULT):
            if i <= done:
                continue
            start = i
            while start > done + 1 and tokens[start - 1] not in BREAKS:
                start -= 1
            state, at, found = 0, start, []
            while at < len(tokens) and tokens[at] not in BREAKS:
                symbol, weight = read[at]
                state, symbol = GRAMMAR[state][symbol]
                if symbol >= INSULT:
                    found.append((symbol, weight))
                at += 1
            done = at
            if found:
                out.append(found)
        return out, words

    def matches(self, text: str) -> tuple[list[tuple[int, float]], int, int]:
        """Matches (symbol, weight) of all clauses, the number of words, and that of clauses with a match."""
        found, words = self.clauses(text)
        return [m for c in found for m in c], words, len(found)

    def features(self, text: str) -> list[float]:
        found, words = self.clauses(text)
        scores = [clause_score(c) for c in found]
        total, strong = sum(scores), [s for s in scores if s > STRONG]
        return [
            math.log1p(total), 10 * total / (words + 20), max(scores, default=0.0), math.log1p(len(scores)), math.log1p(words), 10 * len(strong) / (words + 20), math.log1p(len(strong)),
            float(not words), 1.0,
        ]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Rows (text, toxic): labelled texts that aren't held out, `rows` at most. That bound makes the labels small enough to broadcast. Of the
    labels for one doc_id each counts once; of texts that share it, that of the smallest hash."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    chosen = materialise(chosen, "toxic-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # a doc_id that repeats brings in one text, that of the smallest hash, so the bound holds after the join too
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("t.text", "toxic")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (arc, toxic, texts, times); the arc "" stands for all words."""
    for batch in batches:
        times, texts = (Counter(), Counter()), (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: Counter = Counter()
            for word, n in Counter(t for t in TOKEN.findall(text.lower()) if t not in BREAKS).items():
                found[""] += n
                for arc in arcs(word):
                    found[arc] += n
            times[toxic].update(found)
            texts[toxic].update(found.keys())
        for toxic in (0, 1):
            keys = list(times[toxic])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic] * len(keys), pa.int32()), pa.array([texts[toxic][k] for k in keys], pa.int64()), pa.array([times[toxic][k] for k in keys], pa.int64())], names=["arc", "toxic", "texts", "times"])


def learn_lexicon(training: DataFrame) -> dict[str, float]:
    counts = training.mapInArrow(_counted, "arc string, toxic int, texts long, times long").groupBy("arc").agg(*[F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for c in ("texts", "times") for y in (0, 1)])
    counts = materialise(counts, "arcs")
    total = counts.filter("arc = ''").first()
    if total is None or not total.times0 or not total.times1:
        return {}
    # a fiftieth of the toxic count on the other side keeps rare arcs from weighing more than common ones
    weight = F.log((F.col("times1") + 0.5) / total.times1) - F.log((F.col("times0") + 0.5 + F.col("times1") / 50) / total.times0)
    rows = counts.filter((F.col("arc") != "") & (F.col("texts1") >= LEAST_TEXTS)).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), "arc").limit(LEXICON_ARCS).collect()
    return {r.arc: r.weight for r in rows}


def _featured(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [model.features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """What comes to the driver is the lexicon and FEATURES numbers for each training row, both bounded."""
    bounded_batches(docs.sparkSession)
    training = materialise(training_texts(docs, labels, rows), "toxic-training")
    model = Model(learn_lexicon(training))
    if model.lexicon:
        found = training.mapInArrow(lambda b: _featured(model, b), "x array<double>, toxic int").collect()
        model.weights = fit_logistic(np.array([r.x for r in found]), np.array([r.toxic for r in found], dtype=float))
    return Model(model.lexicon, model.weights)


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.scores([t or "" for t in batch.column(2).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda b: _scored(model, b), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
