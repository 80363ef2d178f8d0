"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, and components.

Two 64-bit fingerprints that differ in at most 2 bits share at least 6 of their 8 positional bytes. The inverted index posts fingerprints by
(position, byte). A list of one posting alone would hold a 256th of all fingerprints, so lists are kept for four postings at a time: the two
that may not be shared spoil at most two of four neighbouring pairs of positions, so of the six choices of two such pairs (BLOCKS) one at least
is shared whole. Within a list every pair has 4 shared bytes; those at its other positions are tallied pair by pair, pairs with MIN_TALLY or
more are retained, and verified bit by bit. Longer lists are first split by two further postings, and where even those are crowded, partners are
probed by exclusive-or masks on the 16 bits that are left instead of forming all pairs. A list of more than LIST_MOST entries is posted anew
under six bytes, where it falls into lists that can't have more than 65,536 entries. A list leaves at most one link for each fingerprint.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; a text of fewer than 3 words is one shingle; a
very long text is read whole, its hashes summed in parts; rows that repeat (or share) a doc_id each get a row, and keep_one() names what ties;
a null doc_id is kept, and is never a component id unless all of its group are null; an empty table gives no rows; other columns are ignored
(in keep_one: returned).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, bounded_batches, components, fresh, join_counted, materialise, row_keys, table

SHINGLE_WORDS, SEED, MAX_BITS, BYTES = 3, 42, 2, 8
#: Equal positional bytes that a pair within MAX_BITS has at least.
MIN_TALLY = BYTES - MAX_BITS
#: Choices of four positions, of which fingerprints with MIN_TALLY shared ones share one whole.
BLOCKS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(BYTES // 2), 2)]
#: The two positions that a choice of six leaves free.
FREE = list(combinations(range(BYTES), MAX_BITS))
#: Lists up to this long are compared by shifting the list against itself; longer ones are split or probed. All ways are exact.
SHORT_LIST = 24
#: The longest list that a task holds.
LIST_MOST = 1 << 16
#: What a row's place takes in a broadcast table, about.
GONE_BYTES = 48
#: Entries that are linked at once, about.
CHUNK = 100_000
ONE_BIT = [1 << b for b in range(16)]
PROBES = np.array(ONE_BIT + [a | b for a, b in combinations(ONE_BIT, 2)], dtype=np.int64)


def fingerprint(data: bytes) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = data.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - SHINGLE_WORDS]]
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE_WORDS - 1 :], strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(x) if x else 0 for x in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keys: list, text: str = "text") -> DataFrame:
    """The key columns of each row and fp, its fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*keys, F.col(f"`{text}`").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_fingerprints, f"{schema}, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    """All bits of the bytes at these positions, as a signed long."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _kept(free: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(p for p in range(BYTES) if p not in free)


def accepted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification, of pairs of fingerprints."""
    x = np.bitwise_xor(a, b)
    tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    return (tally >= MIN_TALLY) & (np.bitwise_count(x.view(np.uint64)) <= MAX_BITS)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n entries reaches over links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for side in (i, j, root[i], root[j]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _bounds(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal numbers."""
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    return starts, np.diff(np.r_[starts, len(lists)])


def _shifted(lists: np.ndarray, sizes: np.ndarray, prints: np.ndarray, found: list) -> None:
    """Add the accepted pairs of lists of SHORT_LIST entries at most."""
    length = np.repeat(sizes, sizes)
    short = np.flatnonzero((length >= 2) & (length <= SHORT_LIST))
    for step in range(1, SHORT_LIST):
        i = short[short + step < len(lists)]
        i = i[lists[i] == lists[i + step]]
        if not len(i):
            break
        i = i[accepted(prints[i], prints[i + step])]
        found.append((i, i + step))


def _six_byte_pairs(lists: np.ndarray, prints: np.ndarray, free: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Accepted pairs (of entries) of whole lists that share six bytes. lists: a number for each entry, equal and adjacent for entries of a list;
    prints: their fingerprints, ascending within a list; free: the list's choice of free bytes."""
    found: list = []
    starts, sizes = _bounds(lists)
    _shifted(lists, sizes, prints, found)
    for s, n in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True):
        part = prints[s : s + n]
        low, high = FREE[int(free[s])]
        value = ((part >> (8 * low)) & 0xFF) | (((part >> (8 * high)) & 0xFF) << 8)
        place = np.full(1 << 16, -1, dtype=np.int64)
        place[value] = np.arange(n)
        for probe in PROBES:
            other = place[value ^ probe]
            i = np.flatnonzero(other > np.arange(n))
            if len(i):
                i = i[accepted(part[i], part[other[i]])]
                found.append((s + i, s + other[i]))
    return found


def _four_byte_pairs(lists: np.ndarray, prints: np.ndarray, block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Accepted pairs of whole lists that share the four bytes of their block."""
    found: list = []
    _, sizes = _bounds(lists)
    _shifted(lists, sizes, prints, found)
    long = np.flatnonzero(np.repeat(sizes, sizes) > SHORT_LIST)
    for number, positions in enumerate(BLOCKS):
        of = long[block[long] == number]
        if not len(of):
            continue
        for free in combinations(_kept(positions), MAX_BITS):
            stem = prints[of] & _mask(_kept(free))
            order = of[np.lexsort((prints[of], stem, lists[of]))]
            stem = prints[order] & _mask(_kept(free))
            new = np.r_[False, (stem[1:] != stem[:-1]) | (lists[order][1:] != lists[order][:-1])]
            found += [(order[i], order[j]) for i, j in _six_byte_pairs(np.cumsum(new), prints[order], np.full(len(order), FREE.index(free)))]
    return found


def _linked(prints: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, a smaller one that it is connected with), one at most for each entry."""
    if not found:
        return prints[:0], prints[:0]
    i, j = (np.concatenate(side) for side in zip(*found, strict=True))
    # the smallest fingerprint has the smallest number
    order = np.argsort(prints, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    root = _local_roots(len(order), number[i], number[j])
    moved = np.flatnonzero(root != np.arange(len(order)))
    return prints[order[moved]], prints[order[root[moved]]]


def link_lists(lists: np.ndarray, prints: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole lists that share six bytes."""
    return _linked(prints, _six_byte_pairs(lists, prints, free))


def _link_postings(find, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (choice, stem, fp), sorted by all three and with whole lists in a partition, to links (u, v) by find(lists, prints, choice). A list
    that isn't over waits for more; one of over LIST_MOST entries is given back as rows (fp, choice, crowded)."""
    held: list[list[np.ndarray]] = []
    crowded: tuple | None = None

    def rows(u: np.ndarray, v: np.ndarray, over: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), over))], names=["u", "v", "crowded"])

    def linked(choice: np.ndarray, stem: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = np.cumsum(np.r_[False, (choice[1:] != choice[:-1]) | (stem[1:] != stem[:-1])])
        sizes = _bounds(lists)[1]
        long = np.repeat(sizes, sizes) > LIST_MOST
        if long.any():
            yield rows(prints[long], choice[long], True)
            choice, lists, prints = choice[~long], lists[~long], prints[~long]
        if len(prints):
            yield rows(*_linked(prints, find(lists, prints, choice)), False)

    def whole(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        """Link what is over and hold the rest."""
        nonlocal held, crowded
        choice, stem, prints = columns
        if crowded is not None:  # more of a list that was given back
            more = (choice == crowded[0]) & (stem == crowded[1])
            if more.any():
                yield rows(prints[more], choice[more], True)
                choice, stem, prints = choice[~more], stem[~more], prints[~more]
        held = []
        if not len(prints):
            return
        ends = np.flatnonzero((choice != choice[-1]) | (stem != stem[-1]))
        cut = len(prints) if last else int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield from linked(choice[:cut], stem[:cut], prints[:cut])
        if cut < len(prints):
            if len(prints) - cut > LIST_MOST:
                crowded = choice[-1], stem[-1]
                yield rows(prints[cut:], choice[cut:], True)
            else:
                held = [[c[cut:]] for c in (choice, stem, prints)]

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        held = [[*h, c] for h, c in zip(held or [[], [], []], columns, strict=True)]
        if sum(map(len, held[0])) >= CHUNK:
            yield from whole([np.concatenate(h) for h in held], False)
    if held:
        yield from whole([np.concatenate(h) for h in held], True)


def _posted(rows: DataFrame, choices: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """Rows (choice, stem, fp), whole lists in a partition and sorted; rows has fp, and choices number the positions that are posted together."""
    stems = F.array(*[F.struct(F.lit(n).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(positions))).alias("stem")) for n, positions in choices])
    posted = rows.select("fp", F.explode(stems).alias("list")).select("list.choice", "list.stem", "fp")
    return posted.repartition("choice", "stem").sortWithinPartitions("choice", "stem", "fp")


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that join distinct fingerprints (column fp) of one component."""
    bounded_batches(prints.sparkSession)
    schema = "u long, v long, crowded boolean"
    found = materialise(_posted(prints, list(enumerate(BLOCKS))).mapInArrow(lambda b: _link_postings(_four_byte_pairs, b), schema), "links")
    out = found.filter("not crowded").select("u", "v")
    crowded = found.filter("crowded").select(F.col("u").alias("fp"), F.col("v").alias("block"))
    for n in [r.block for r in crowded.select("block").distinct().collect()]:  # six at most
        choices = [(FREE.index(free), _kept(free)) for free in combinations(_kept(BLOCKS[n]), MAX_BITS)]
        out = out.unionByName(_posted(crowded.filter(F.col("block") == n), choices).mapInArrow(lambda b: _link_postings(_six_byte_pairs, b), schema).select("u", "v"))
    return out


def near_duplicates(prints: DataFrame, doc_id: str) -> DataFrame:
    """From rows with doc_id and fp (materialised): for each distinct fp its number of rows, its component's root and smallest doc_id."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("n")), "prints")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.u, "left").select("fp", "least", "n", F.coalesce("v", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return join_counted(rooted, named, "root", "members", distinct.count()).select("fp", "n", "root", "component_id")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    prints = materialise(fingerprints(docs, [F.col(f"`{doc_id}`").alias("doc_id")], text), "simhash")
    groups = near_duplicates(prints, "doc_id").select("fp", "n", "component_id")
    return join_counted(prints, groups, "fp", "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _is_scan(df: DataFrame) -> bool:
    """Whether df is nothing but the scan of files, so that a file's name and a row's number in it stand for one row."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that with the smallest doc_id (nulls last; of rows that share it, that
    with the smallest row hash; of wholly equal rows, the first by file and place). Rows are known by their file and place in it, so equal ones
    never have to meet; a DataFrame that isn't a table's scan is written first. Texts aren't shuffled while those that go are few by count."""
    docs = docs if _is_scan(docs) else materialise(docs, "documents")
    file, at = (fresh(docs, x) for x in ("file", "at"))
    place = docs.metadataColumn("_metadata")
    a, b = row_keys(docs)
    keyed = docs.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(at))
    keys = [F.col(f"`{doc_id}`").alias("doc_id"), a.alias("a"), b.alias("b"), F.col(file).alias("file"), F.col(at).alias("at")]
    prints = materialise(fingerprints(keyed, keys, text), "simhash")
    groups = near_duplicates(prints, "doc_id").select("fp", "root")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b", "file", "at")).alias("best")
    chosen = prints.groupBy("fp").agg(best).join(groups, "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.file", "best.at")
    gone = materialise(prints.select("file", "at").join(chosen, ["file", "at"], "left_anti").select(F.col("file").alias(file), F.col("at").alias(at)), "duplicates")
    few = gone.count() * GONE_BYTES <= BROADCAST_BYTES
    return keyed.join(F.broadcast(gone) if few else gone, [file, at], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
