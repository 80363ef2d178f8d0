"""Benchmark decontamination by winnowing, in DataFrame functions only.

The words of each document are hashed in k-grams, and of every w consecutive hashes the smallest is kept. With k + w - 1 = 13, each 13-word
window that a document shares with a benchmark item leaves a fingerprint that both have. Documents' fingerprints are joined with those of the
benchmark; each hit compares the words around it on both sides and is extended to the longest common run that the window allows. Items of
fewer than 13 words are one window each; every length that occurs has its own k and w, with k + w - 1 that length.

Whatever the size of the benchmark, two passes are made over the documents. The first leaves a row for each document and for each fingerprint
that the benchmark has too: numbers only, whatever a text's length. The second reads the words around hits, in documents that have any. The
benchmark's hashes are broadcast if they are few by count; otherwise fingerprints are shuffled to meet them, salted, as rows of numbers. Lists
of items that have the same words are kept once, and documents refer to them; so a preamble that all items share costs one list.

Defined cases: a null or empty text has no words, and is neither hit nor hits; a very long text is read whole, and its words aren't copied for
each of its fingerprints; of equal hashes in a window the leftmost counts; a null item_id is spelled as an empty string; items are told apart by
item_id; documents that share a doc_id, or repeat wholly, each get a row; a null doc_id is kept; an empty benchmark hits nothing; an empty table
gives no rows; other columns are ignored (in drop_contaminated: returned).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, ascii_lower, fresh, join_sized, let, materialise, row_keys, table

WINDOW = 13
#: Between words: ASCII characters that are neither digits nor lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The bits of a packed fingerprint that hold its position; the hash is above.
PLACE_BITS = 30
#: Hashes of the benchmark that are broadcast at most, of some 40 bytes; and what a pair of row keys with a few numbers takes.
SLICE_ROWS, KEY_BYTES = BROADCAST_BYTES // 40, 160
#: Tasks that equal fingerprints are dealt to where the benchmark's hashes are too many to be broadcast.
SALTS = 32
PERCENT = 20


def words_of(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(lowered, GAPS, -1), lambda w: w != "")


def gram_length(length: int) -> int:
    """k for windows of so many words: 5 of 13."""
    return max(1, (2 * length + 4) // 6)


def winnowed(hashes: Column, length: int) -> Column:
    """Packed fingerprints (hash above position) of an array of word hashes: of each w k-grams in a row the smallest. Equal hashes take the
    leftmost; arrays shorter than `length` have none."""
    k = gram_length(length)
    w = length - k + 1
    low = F.lit((1 << PLACE_BITS) - 1)

    def packed(i: Column) -> Column:
        return F.xxhash64(F.lit(length), *[F.element_at(hashes, i + n) for n in range(k)]).bitwiseAND(F.bitwise_not(low.cast("long"))).bitwiseOR(i.cast("long"))

    def smallest(grams: Column) -> Column:
        least = lambda i: F.least(*[F.element_at(grams, i + n) for n in range(w)]) if w > 1 else F.element_at(grams, i)
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - (w - 1)), least))

    least = let(F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), packed), smallest)
    return F.when(F.size(hashes) >= length, least).otherwise(F.array().cast("array<long>"))


def _mark(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    """1-based position of a fingerprint's first word."""
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _around(words: Column, place: Column, length: int | Column, k: int | Column) -> tuple[Column, Column, Column]:
    """The words before a k-gram (nearest first), its own, and those after it, as far as a window over it can reach."""
    reach = F.lit(length) - F.lit(k)
    before = F.greatest(F.lit(1), place - reach)
    return F.reverse(F.slice(words, before, place - before)), F.slice(words, place, F.lit(k)), F.slice(words, place + F.lit(k), reach)


def benchmark_index(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Rows (mark, length, left, gram, right, items_id): the surroundings of each fingerprint of the benchmark and what items have them; rows
    (items_id, items), each list of items once; and the lengths of windows that occur."""
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    worded = materialise(worded.withColumn("length", F.least(F.size("words"), F.lit(WINDOW))), "benchmark")
    lengths = [r.length for r in worded.select("length").distinct().orderBy("length").collect()]  # 13 at most
    spark = worded.sparkSession
    every = spark.createDataFrame([], "length int, mark long, left array<string>, gram array<string>, right array<string>, item string")
    for n in lengths:
        posted = worded.filter(F.col("length") == n).select("item", "length", F.explode(let(F.col("words"), _all_surrounded(n))).alias("x"))
        every = every.unionByName(posted.select("length", "x.mark", "x.left", "x.gram", "x.right", "item"))
    listed = every.groupBy("length", "mark", "left", "gram", "right").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = materialise(listed.withColumn("items_id", F.sha1(F.array_join(F.transform("items", lambda i: F.concat(F.char_length(i).cast("string"), F.lit(":"), i)), ""))), "benchmark-index")
    return listed.drop("items"), listed.groupBy("items_id").agg(F.first("items").alias("items")), lengths


def _all_surrounded(length: int) -> Callable[[Column], Column]:
    return lambda words: F.transform(_winnowed_words(words, length), _surrounded(words, length))


def _surrounded(words: Column, length: int) -> Callable[[Column], Column]:
    """A fingerprint with its mark, its place, and the words around it."""
    k = gram_length(length)

    def of(packed: Column) -> Column:
        left, gram, right = _around(words, _place(packed), length, k)
        return F.struct(F.lit(length).alias("length"), _mark(packed).alias("mark"), _place(packed).alias("place"), left.alias("left"), gram.alias("gram"), right.alias("right"))

    return of


def _winnowed_words(words: Column, length: int) -> Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: winnowed(h, length))


def _common(a: Column, b: Column) -> Column:
    """The number of equal words at the start of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs.cast("int") - 1)


def _met(docs: DataFrame, index: DataFrame, lengths: list[int], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows (doc_id, a, b, n_words, length, packed): one with a null `packed` and n_words for each row of docs, and one for each of its fingerprints whose
    hash the benchmark has. a and b are the row's keys."""
    a, b = row_keys(docs)
    worded = docs.select("doc_id", a.alias("a"), b.alias("b"), words_of(F.col("text").cast("string")).alias("words"))
    # nothing but columns of numbers goes along with what is exploded: an expression on the words would be taken after it, and the words copied
    itself = lambda h: F.struct(F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("packed"), F.size(h).cast("long").alias("n_words"))
    marks = lambda h: F.concat(F.array(itself(h)), *[F.transform(winnowed(h, n), _tagged(n)) for n in lengths])
    posted = worded.select("doc_id", "a", "b", F.explode(let(F.transform("words", lambda w: F.xxhash64(w)), marks)).alias("post"))
    # a document's own row has no mark; its key stands in, so that such rows don't meet
    posted = posted.select("doc_id", "a", "b", "post.*", F.coalesce(_mark(F.col("post.packed")), F.col("a")).alias("mark"))
    known = materialise(index.select("mark").distinct().withColumn("known", F.lit(True)), "benchmark-marks")
    if known.count() <= slice_rows:
        joined = posted.join(F.broadcast(known), "mark", "left")
    else:
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = posted.withColumn("salt", F.pmod(F.xxhash64("a", "packed"), F.lit(SALTS)).cast("int")).join(dealt, ["mark", "salt"], "left")
    return materialise(joined.filter(F.col("packed").isNull() | F.col("known")).select("doc_id", "a", "b", "n_words", "length", "packed"), "fingerprints")


def _verified(docs: DataFrame, met: DataFrame, index: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (a, b, n_hit, lists) of documents (by their keys) with real hits; lists are the ids of their hits' lists of items."""
    hits = materialise(met.filter("packed is not null").groupBy("a", "b").agg(F.collect_set(F.struct("length", "packed")).alias("hits")), "hits")
    size = hits.agg(F.sum(F.size("hits") * 24 + F.lit(KEY_BYTES))).first()[0] or 0
    a, b = row_keys(docs)
    texts = join_sized(docs.select(a.alias("a"), b.alias("b"), F.col("text").cast("string").alias("text")), hits, ["a", "b"], "inner", size)
    of_length = lambda n: lambda h: h["length"] == n
    around = lambda w: F.flatten(F.array(*[F.transform(F.transform(F.filter("hits", of_length(n)), lambda h: h["packed"]), _surrounded(w, n)) for n in lengths or [WINDOW]]))
    found = texts.select("a", "b", F.explode(let(words_of(F.col("text")), around)).alias("d"))
    found = found.select("a", "b", F.col("d.length").alias("length"), F.col("d.mark").alias("mark"), "d.place", *[F.col(f"d.{c}").alias(f"d_{c}") for c in ("left", "gram", "right")])
    size = index.agg(F.sum(F.char_length(F.concat_ws(" ", "left", "gram", "right")) + F.lit(24 * 2 * WINDOW + KEY_BYTES))).first()[0] or 0
    found = join_sized(found, index, ["mark", "length"], "inner", size)
    k = F.expr("case length " + " ".join(f"when {n} then {gram_length(n)}" for n in range(1, WINDOW + 1)) + " end")
    found = found.withColumns({"k": k, "back": _common(F.col("left"), F.col("d_left")), "ahead": _common(F.col("right"), F.col("d_right"))})
    real = found.filter((F.col("gram") == F.col("d_gram")) & (F.col("back") + F.col("k") + F.col("ahead") >= F.col("length")))
    run = F.struct((F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("k") + F.col("ahead")).alias("end"))
    summed = real.groupBy("a", "b").agg(F.collect_set(run).alias("runs"), F.array_sort(F.collect_set("items_id")).alias("lists"))
    return materialise(summed.select("a", "b", _covered(F.col("runs")).alias("n_hit"), "lists"), "contaminated")


def _named(found: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows (a, b, n_hit, n_items, items_sha256). Items are united once for each set of lists that occurs, not for each document."""
    keyed = found.withColumn("lists_id", F.sha1(F.array_join("lists", ",")))
    sets = materialise(keyed.groupBy("lists_id").agg(F.first("lists").alias("lists")), "item-lists")
    items = sets.select("lists_id", F.explode("lists").alias("items_id")).join(lists, "items_id").select("lists_id", F.explode("items").alias("item"))
    united = items.groupBy("lists_id").agg(F.array_sort(F.collect_set("item")).alias("items")).select("lists_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    united = materialise(united, "item-sets")
    return join_sized(keyed.drop("lists"), united, ["lists_id"], "inner", united.count() * KEY_BYTES).select("a", "b", "n_hit", "n_items", "items_sha256")


def _is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (PERCENT * F.col("n_hit") >= F.col("n_words"))


def _tagged(length: int):
    return lambda p: F.struct(F.lit(length).alias("length"), p.alias("packed"), F.lit(None).cast("long").alias("n_words"))


def _covered(runs: Column) -> Column:
    """The number of words in the union of runs [start, end)."""
    step = lambda acc, r: F.struct(F.greatest(acc["to"], r["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(acc["to"], r["start"]))).alias("n"))
    return F.aggregate(F.array_sort(runs), F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs; items has item_id and text. Hashes of the benchmark
    are broadcast if there are no more than slice_rows; if there are, fingerprints are shuffled to them."""
    docs = docs.select("doc_id", "text")
    index, lists, lengths = benchmark_index(items)
    met = _met(docs, index, lengths, slice_rows)
    named = materialise(_named(_verified(docs, met, index, lengths), lists), "judged")
    whole = join_sized(met.filter("packed is null"), named, ["a", "b"], "left", named.count() * KEY_BYTES)
    whole = whole.select("doc_id", "n_words", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_hit", "n_items")], F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return whole.withColumn("contaminated", _is_contaminated())


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones, whose keys come to them as join_sized() says."""
    narrow = docs.select("doc_id", "text")
    index, _, lengths = benchmark_index(items)
    met = _met(narrow, index, lengths)
    found = _verified(narrow, met, index, lengths)
    judged = join_sized(met.filter("packed is null"), found.drop("lists"), ["a", "b"], "inner", found.count() * KEY_BYTES)
    a, b = (fresh(docs, x) for x in ("key_a", "key_b"))
    bad = materialise(judged.filter(_is_contaminated()).select(F.col("a").alias(a), F.col("b").alias(b)).distinct(), "contaminated-keys")
    keyed = docs.withColumns(dict(zip((a, b), row_keys(narrow), strict=True)))
    return join_sized(keyed, bad, [a, b], "left_anti", bad.count() * KEY_BYTES).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
