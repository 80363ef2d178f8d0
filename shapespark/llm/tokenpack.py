"""Token ids in a bit-packed binary format.

An image holds the ids of whole documents, each id in the fewest bits that hold the vocabulary. Ids come in blocks of BLOCK_IDS; a table of
block offsets lets any range of ids be read, and numpy unpacks a block at once. Layout, little-endian: magic, bits, block size, counts of
documents, ids and blocks; doc ids; their validity; the end of each document in ids; the offset of each block in bytes; the blocks.

Images are written as rows of a Parquet table (part, before, image), in ascending order of doc_id over parts and rows, so Spark's own
committer keeps them whole when executors are lost, on any file system that Spark reaches.

Defined cases: a null text is an empty one, and an empty one has the end id alone; a very long text is encoded whole, in an image of its own
size; a null doc_id comes first; rows that share a doc_id are ordered by their text's hash and text, and wholly equal ones in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, scratch_path, table

MAGIC, HEAD = b"FWP1", struct.Struct("<4sIIQQQ")
BLOCK_IDS, IMAGE_IDS = 4096, 1 << 16
END_ID = 2
ALIGNED = {8: ">u1", 16: ">u2", 32: ">u4"}
#: Distinct pieces of text whose ids a worker remembers, at most; then it starts over.
REMEMBERED = 500_000
#: Unknown pieces that go to the library in one string.
RUN = 256
_tokenizers: dict = {}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Most significant bit first. Widths of whole bytes are plain casts to the same layout."""
    if bits in ALIGNED:
        return ids.astype(ALIGNED[bits]).tobytes()
    return np.packbits(np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in ALIGNED:
        return np.frombuffer(data, ALIGNED[bits], n).astype("<u4")
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


def write_image(doc_ids: list[int | None], documents: list[np.ndarray], bits: int) -> bytes:
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    blocks = [pack(ids[at : at + BLOCK_IDS], bits) for at in range(0, len(ids), BLOCK_IDS)]
    ends = np.cumsum([len(d) for d in documents], dtype="<u8")
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, bits, BLOCK_IDS, len(documents), len(ids), len(blocks)), numbers.tobytes(), known.tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class Image:
    """Reads an image; ids(start, stop) unpacks only the blocks that hold the range."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not an image of packed ids")
        at = HEAD.size
        numbers = np.frombuffer(data, "<i8", docs, at)
        known = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
        self.doc_ids = [int(n) if k else None for n, k in zip(numbers, known, strict=True)]
        self.ends = np.frombuffer(data, "<u8", docs, at := at + docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


#: A space between two characters that aren't white space. Byte-level pre-tokenization starts a token there whatever surrounds it.
INNER_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: White space beyond ASCII, and pairs of a space and other ASCII white space.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Most texts have none of these characters but line feeds: looking for one of them costs less than looking for two pairs.
SPACE_PAIRS = {c: (" " + c, c + " ") for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"}


def odd_space(text: str) -> bool:
    """Whether some space of the text may not be an inner one."""
    return text[:1] == " " or text[-1:] == " " or any([c in text and (a in text or b in text) for c, (a, b) in SPACE_PAIRS.items()]) or not text.isascii() and bool(WIDE_SPACE.search(text))


class Encoder:
    """Encodes texts as the tokenizers library does, asking it once for each distinct piece between inner spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        kind = type(self.model.pre_tokenizer).__name__
        self.split = kind == "ByteLevel" and self.model.normalizer is None and not self.model.pre_tokenizer.add_prefix_space
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        #: Whether a token starts with a space, as byte-level vocabularies write it.
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _room(self, memory: dict[str, bytes], pieces: set[str]) -> list[str]:
        if len(memory) + len(pieces) > REMEMBERED:
            memory.clear()
        return list(pieces.difference(memory))

    def _learn_spaced(self, pieces: set[str]) -> None:
        """Pieces after an inner space. Strung together, each starts at the only token that starts with a space."""
        new = self._room(self.spaced, pieces)
        runs = [new[at : at + RUN] for at in range(0, len(new), RUN)]
        for run, data in zip(runs, self.whole([" " + " ".join(run) for run in runs]), strict=True):
            starts = np.flatnonzero(self.opens[np.frombuffer(data, "<u4")]) * 4
            if len(starts) != len(run) or starts[0]:
                self.spaced.update(zip(run, self.whole([" " + p for p in run]), strict=True))
            else:
                self.spaced.update((p, data[s:e]) for p, s, e in zip(run, starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True))

    def _learn(self, pieces: set[str]) -> None:
        new = self._room(self.known, pieces)
        self.known.update(zip(new, self.whole(new), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        if not self.split:
            return self.whole(texts)
        plain, odd, entire = [], [], []
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                entire.append(i)
            elif odd_space(text):
                odd.append((i, INNER_SPACE.split(text)))
            elif text:
                plain.append((i, text.split(" ")))
        for i, ids in zip(entire, self.whole([texts[i] for i in entire]), strict=True):
            out[i] = ids
        self._learn_spaced(set(chain.from_iterable(p[1:] for _, p in plain)))
        self._learn({p[0] for _, p in plain} | set(chain.from_iterable(p for _, p in odd)))
        for i, pieces in plain:
            out[i] = self.known[pieces[0]] + b"".join(map(self.spaced.__getitem__, pieces[1:]))
        for i, pieces in odd:
            out[i] = b"".join(map(self.known.__getitem__, pieces))
        return out


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def pack_partition(path: str, bits: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text), ordered within the partition, to images. before counts the partition's ids ahead of an image."""
    part, before, model = TaskContext.get().partitionId(), 0, encoder(path)
    doc_ids: list[int | None] = []
    documents: list[np.ndarray] = []
    held = 0
    end = np.array([end_id], "<u4")

    def image() -> pa.RecordBatch:
        columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([write_image(doc_ids, documents, bits)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "before", "n_ids", "image"])

    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for doc_id, data in zip(batch.column(0).to_pylist(), model.encode(texts), strict=True):
            doc_ids.append(doc_id)
            documents.append(np.concatenate([np.frombuffer(data, "<u4"), end]))
            held += len(documents[-1])
            if held >= IMAGE_IDS:
                yield image()
                before, held, doc_ids, documents = before + held, 0, [], []
    if documents:
        yield image()


def write_packed(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write docs' ids to the table `out`, in ascending order of doc_id."""
    bounded_batches(docs.sparkSession)
    bits = bits_for(max(vocabulary, end_id + 1))
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(f"`{text}`").alias("h"), F.spark_partition_id().alias("part"))
    # equal rows, which are in any order, are dealt out by where they are read
    ordered = source.repartitionByRange("doc_id", "h", "part").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(lambda batches: pack_partition(tokenizer, bits, end_id, batches), "part int, before long, n_ids long, image binary").write.parquet(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            image = Image(data)
            ids = image.ids(0, image.n_ids)
            starts = np.r_[0, image.ends[:-1]]
            crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts, image.ends, strict=True)]
            columns = [pa.array(image.doc_ids, pa.int64()), pa.array(start + starts), pa.array(image.ends - starts), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def placed(spark: SparkSession, path: str) -> DataFrame:
    """The images of a table with start, the ids of all documents before the image. The offsets of parts are one row for each partition that
    wrote, a number that the session sets, so they can be broadcast."""
    images = spark.read.schema("part int, before long, n_ids long, image binary").parquet(path)
    total = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = total.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return images.join(F.broadcast(offsets), "part").select((F.col("ahead") + F.col("before")).alias("start"), "image")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """For each document of a table of images: doc_id, start, n_tokens and the checksum of its ids."""
    return placed(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch_path(spark, "packed-ids")
    write_packed(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 50_257)
    return read_digests(spark, out)
