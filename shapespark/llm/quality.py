"""Quality rules for documents and, from them, verdicts on hosts.

Each document gets counts and the rules that it fails. For every host the failures of each rule are counted, and their rates are shrunken
towards the corpus by a beta prior fitted to all hosts (method of moments), so that a host of few documents isn't judged on them alone. A
host is rejected if the shrunken rate of some rule exceeds HOST_LIMIT; the verdict is joined back to the host's documents. A document is
kept if it passes the base rules and its host isn't rejected.

Defined cases: a null or empty text has no words, and so fails the base rules; a very long text is measured whole; a rate that equals the limit
is within it; rows of a null host count as one host; rows that share a doc_id, or repeat wholly, each get a row, and each counts for its host;
an empty table gives no rows; other columns are ignored (in filter_quality: returned).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, bounded_batches, fresh, materialise, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
#: Rules that count for hosts, as conditions on the counts of a document that fails them.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
HOST_LIMIT = 0.5
PRIOR_DOCUMENTS = 10.0
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SALTS = 64


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has twice or more."""
    n = len(words)
    if n < WINDOW + 1:
        return 0
    number: dict[bytes, int] = {}
    fresh_number = count()
    ids = np.array([number[w] if w in number else number.setdefault(w, next(fresh_number)) for w in words], dtype=np.int64)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(n, dtype=bool)
    again = times[window] > 1
    for shift in range(WINDOW):
        hit[shift : n - WINDOW + 1 + shift] |= again
    return int(hit.sum())


def metrics(data: bytes) -> tuple[int, ...]:
    """METRICS of a UTF-8 text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = np.frombuffer(b"".join(words), np.uint8)
    return len(words), int(((letters & 0xC0) != 0x80).sum()), len(data) - len(data.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, is replaced by its metrics."""
    for batch in batches:
        rows = np.array([metrics(x or b"") for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()], dtype=np.int64).reshape(-1, len(METRICS))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in rows.T)], names=[*batch.schema.names[:-1], *METRICS])


def measure(docs: DataFrame, keys: list, text: str = "text") -> DataFrame:
    """The key columns of each row and its metrics."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*keys, F.col(f"`{text}`").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_measured, f"{schema}, " + ", ".join(f"{m} long" for m in METRICS))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """A beta distribution with the given mean and variance over hosts. It counts as PRIOR_DOCUMENTS documents at least, so that a handful of
    documents never decides on a host."""
    mean = min(max(mean or 0.0, 1e-6), 1 - 1e-6)
    strength = max(mean * (1 - mean) / variance - 1, PRIOR_DOCUMENTS) if variance and variance > 0 else PRIOR_DOCUMENTS
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host and rejected, from rows with host and metrics. Counts are summed before they are shuffled; ten numbers on the spread of rates over
    all hosts come to the driver."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"if({rule}, 1, 0)")).alias(name) for name, rule in RULES.items()])
    spread = hosts.agg(F.sum("n").alias("n"), *[e for r in RULES for e in (F.sum(r).alias(r), F.var_pop(F.col(r) / F.col("n")).alias(f"{r}_var"))]).first()
    worst = F.lit(False)
    for rule in RULES:
        a, b = beta_prior((spread[rule] or 0) / spread["n"] if spread["n"] else 0.0, spread[f"{rule}_var"])
        worst |= (F.col(rule) + a) / (F.col("n") + a + b) > limit
    return hosts.select("host", worst.alias("rejected"))


def judged(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """measured with rejected, its host's verdict. Verdicts are broadcast if their rejected hosts are few by count; else both sides are dealt
    out by host and salt, so that no host's documents meet in one task."""
    bad = materialise(verdicts.filter("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("rejected")), "hosts")
    if bad.count() * 200 <= BROADCAST_BYTES:
        return measured.join(F.broadcast(bad), F.col("host").eqNullSafe(F.col("bad_host")), "left").withColumn("rejected", F.coalesce("rejected", F.lit(False))).drop("bad_host")
    salt = fresh(measured, "salt")
    left = measured.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    right = bad.withColumn("bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("host").eqNullSafe(F.col("bad_host")) & (F.col(salt) == F.col("bad_salt"))
    return left.join(right, same, "left").withColumn("rejected", F.coalesce("rejected", F.lit(False))).drop("bad_host", "bad_salt", salt)


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the metrics, base_failed, host_rejected and kept of each row."""
    measured = materialise(measure(docs, [F.col("doc_id"), F.col(f"`{host}`").alias("host")]), "quality")
    out = judged(measured, host_verdicts(measured)).withColumn("base_failed", base_failed())
    return out.select("doc_id", "host", *METRICS, "base_failed", F.col("rejected").alias("host_rejected"), (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))


def filter_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps. Texts are measured again rather than shuffled to meet their verdicts."""
    verdicts = host_verdicts(materialise(measure(docs, [F.col(f"`{host}`").alias("host")]), "quality"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{host}`").alias("host"), F.col("text"))
    kept = judged(measure(whole, ["row", "host"]), verdicts).filter(~base_failed() & ~F.col("rejected"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
