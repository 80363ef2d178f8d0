"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

The distinct words of a batch are laid out as one flat numpy array of symbols. Each round finds the best pair of every word (a segmented
minimum of pair ranks), merges its leftmost occurrences in all words at once, and compacts the arrays, until no pair remains.

The order must be that of a queue by (score, position). A merged piece may form a pair with a neighbour that comes before the word's further
occurrences of the best pair. What follows from such a merge stays within the pieces that contain it, so occurrences that are farther apart
than two longest pieces don't see each other. Of those that are closer (a cluster), the leftmost are merged, up to and with the first that
really forms a pair as good; the others wait for the rounds that its consequences take. Long words are cut beforehand between characters that
no piece has side by side, as no merge can cross that place.

Defined cases: a null text is an empty one, and an empty one has the begin and end ids alone; a very long text, or word, is encoded whole; of
pairs with equal scores the leftmost is merged; rows that share a doc_id, or repeat wholly, each get a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.iinfo(np.int32).max
#: Distinct words whose ids a worker remembers, at most, and the longest of them; then it starts over.
REMEMBERED, LONGEST = 300_000, 64
_models: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """A BPE model file with byte fallback, identity normalization and a dummy space before the text."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        pieces = [dict(_fields(value)) for field, value in message if field == 1]
        self.text = [p[1].decode() for p in pieces]
        self.kind = np.array([p.get(3, NORMAL) for p in pieces])
        trainer, norm = (dict(_fields(next(v for f, v in message if f == n))) for n in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not set(self.kind) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without normalization or user-defined pieces are read")
        self.size, self.begin, self.end = len(pieces), trainer.get(41, 1), trainer.get(42, 2)
        self.id = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.byte = np.zeros(256, dtype=np.int64)
        for i in np.flatnonzero(self.kind == BYTE):
            self.byte[int(self.text[i][1:-1], 16)] = i
        if any(c not in self.id for c in set("".join(self.id))):
            raise ValueError("a character of some piece isn't a piece")
        score = {i: struct.unpack("<f", pieces[i][2])[0] if 2 in pieces[i] else 0.0 for i in self.id.values()}
        place = {s: n for n, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: place[s] for i, s in score.items()}
        self.unsafe = np.zeros(self.size, dtype=bool)
        shared = np.bincount(list(rank.values()))
        table = []
        for t, i in self.id.items():
            self.unsafe[i] |= shared[rank[i]] > 1
            for cut in range(1, len(t)):
                a, b = self.id.get(t[:cut]), self.id.get(t[cut:])
                if a is not None and b is not None:
                    table.append((a * self.size + b, rank[i], i))
                    for half in (a, b):
                        self.unsafe[half] |= rank[i] <= rank[half]
        self._hash_pairs(*(np.array(x, dtype=np.int64) for x in zip(*table, strict=True)))
        self._char_ids()
        longest = max(map(len, self.id))
        #: Symbols between two merges that can't see each other.
        self.apart = 2 * longest + 2
        self.bridges = np.unique(np.array([(ord(a) << 21) | ord(b) for t in self.id for a, b in zip(t, t[1:], strict=False)], dtype=np.int64))
        self.joins_spaces = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.id)
        unk = trainer.get(44, b" \xe2\x81\x87 ")
        kinds = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), UNKNOWN: lambda t: unk, CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[1:-1], 16)])}
        self.surface = [kinds[k](t) for k, t in zip(self.kind.tolist(), self.text, strict=True)]
        self.known: dict[str, bytes] = {}
        self.grown: dict[int, tuple[int, list[int]]] = {}

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table of pairs; `probes` steps find any key."""
        self.bits = int(8 * len(keys)).bit_length()
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.ranks, self.made = np.full(len(self.keys), NONE, dtype=np.int32), np.zeros(len(self.keys), dtype=np.int32)
        left, step = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(left):
            at = home[left] + step
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several keys that want a place the last gets it
            got = self.keys[at] == keys[left]
            self.ranks[at[got]], self.made[at[got]] = ranks[left[got]], made[left[got]]
            left, step = left[~got], step + 1
        self.probes = step

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _char_ids(self) -> None:
        """The id of each code point that is a piece, else -1."""
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for t, i in self.id.items():
            if len(t) == 1:
                self.char[ord(t)] = i

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece that each pair of symbols merges to; NONE where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = self._home(key)
        found = self.keys[at]
        left = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(left):
                break
            at[left] += 1
            found = self.keys[at[left]]
            left = left[(found != key[left]) & (found >= 0)]
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], 0)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters' ids of all words, flat, and the number of each one's word. Characters that aren't pieces become their bytes."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = self.char[codes]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, word
        data = [chr(c).encode("utf-8", "replace") for c in codes[odd]]
        n = np.ones(len(codes), dtype=np.int64)
        n[odd] = [len(x) for x in data]
        out = np.repeat(ids, n)
        out[out < 0] = self.byte[np.frombuffer(b"".join(data), np.uint8)]
        return out, np.repeat(word, n)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        sym, word = self.symbols(words)
        done_sym, done_word = [], []
        rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym))]
            inner = at[(at + 1 < len(sym))]
            inner = inner[word[inner] == word[inner + 1]]
            rank[at] = NONE
            rank[inner], made[inner] = self.pairs(sym[inner], sym[inner + 1])

        look(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            open_ = np.repeat(best != NONE, sizes)
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                sym, word, rank, made = (x[open_] for x in (sym, word, rank, made))
                best, sizes = best[best != NONE], sizes[best != NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # of overlapping occurrences (aaa) the leftmost, then every second one
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.r_[True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])], place, 0))
            at = at[(place - run) % 2 == 0]
            at = at[self._in_turn(at, sym, word, rank, made)]
            gone = self._grow_runs(at, sym, word, rank, made)
            sym[at] = made[at]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            if len(gone):
                at = np.union1d(at, gone[:, 0])
                for head, piece, length in gone.tolist():
                    sym[head] = piece
                    stay[head + 1 : head + length] = False
            sym, word, rank, made = (x[stay] for x in (sym, word, rank, made))
            at = (np.cumsum(stay) - 1)[at]
            look(at)
            look(at - 1)
        if not done_sym:
            return [b""] * len(words)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        data = np.concatenate(done_sym)[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [data[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _in_turn(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which occurrences of their words' best pairs, none of which overlap, are merged in this round."""
        risky = self.unsafe[made[at]]
        if not risky.any():
            return np.ones(len(at), dtype=bool)
        piece, own = made[at], word[at]
        heads = np.r_[True, (own[1:] != own[:-1]) | (np.diff(at) >= self.apart)]
        follows = np.r_[False, (np.diff(at) == 2) & ~heads[1:]]

        def better(inside: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), dtype=bool)
            i = np.flatnonzero(inside)
            out[i] = self.pairs(left[i], right[i])[0] <= rank[at[i]]
            return out

        before, behind = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        # where the occurrence before it touches it, that one's piece is the neighbour by then
        left = np.where(follows, np.r_[piece[:1], piece[:-1]], sym[before])
        loud = risky & (better((at > 0) & (word[before] == own), left, piece) | better((at + 2 < len(sym)) & (word[behind] == own), piece, sym[behind]))
        # none that is louder may come before it in its cluster
        earlier = np.cumsum(loud) - loud
        return ~risky | (earlier == np.maximum.accumulate(np.where(heads, earlier, 0)))

    def _growth(self, symbol: int) -> tuple[int, list[int]]:
        """How many symbols of a long run of one symbol turn into one piece, again and again, while its pairs are the best; and all pieces that
        come up, that one last. 0 if pieces that are made don't stay apart."""
        if symbol not in self.grown:
            one = lambda a, b: tuple(int(x[0]) for x in self.pairs(np.array([a]), np.array([b])))
            best, _ = one(symbol, symbol)
            run, size, seen = [symbol] * 3 * self.apart, [1] * 3 * self.apart, {symbol}
            while True:
                found = [one(a, b) for a, b in zip(run, run[1:], strict=False)]
                rank, i = min(((r, i) for i, (r, _) in enumerate(found)), default=(NONE, 0))
                if rank > best:
                    break
                run[i : i + 2], size[i : i + 2] = [found[i][1]], [size[i] + size[i + 1]]
                seen.add(run[i])
            last = run[0]
            apart = len(run) > 2 and run[1] == last and size[0] > 2 and min(one(last, x)[0] for x in seen) > best
            self.grown[symbol] = (size[0], [*(seen - {last}), last]) if apart else (0, [])
        return self.grown[symbol]

    def _grow_runs(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Rows (place, piece, symbols): for the first pair of a long run of one symbol (such as spaces), the pieces that the run turns into one
        after another, but for its end. They don't see each other, so they are made at once."""
        out: list[tuple] = []
        most = self.apart
        i = at[(at + 2 * most < len(sym)) & self.unsafe[made[at]]]
        i = i[(sym[i] == sym[i + 1]) & (sym[i] == sym[np.minimum(i + 2 * most, len(sym) - 1)])]
        for head in i.tolist():
            length, pieces = self._growth(int(sym[head]))
            if not length:
                continue
            same = (sym[head:] == sym[head]) & (word[head:] == word[head])
            run = len(same) if same.all() else int(same.argmin())
            before = head > 0 and word[head - 1] == word[head]
            if before and self.pairs(np.full(len(pieces), sym[head - 1]), np.array(pieces))[0].min() <= rank[head]:
                continue
            out += [(head + length * k, pieces[-1], length) for k in range(run // length - 1)]
        return np.array(out, dtype=np.int64).reshape(-1, 3)

    def _cut(self, word: str) -> list[str]:
        """A long word's parts between characters that no piece has side by side."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pair = (codes[:-1] << 21) | codes[1:]
        found = np.searchsorted(self.bridges, pair)
        cuts = np.flatnonzero(self.bridges[np.minimum(found, len(self.bridges) - 1)] != pair) + 1
        return [word[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with the begin and end ids."""
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif self.joins_spaces:
                split.append([SPACE + text.replace(" ", SPACE)])
            elif "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
                split.append(re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE)))
            else:
                split.append((SPACE + text.replace(" ", " " + SPACE)).split(" "))
        split = [words if max(map(len, words), default=0) <= LONGEST else [p for w in words for p in (self._cut(w) if len(w) > LONGEST else (w,))] for words in split]
        distinct = set(chain.from_iterable(split))
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        new = [w for w in distinct if w not in self.known]
        found = dict(zip(new, self.merge(new), strict=True))
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST)
        lookup = _Both(self.known, found)
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        return [b"".join([begin, *map(lookup.__getitem__, words), end]) for words in split]

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        start, stop = int(ids[:1] == [self.begin]), len(ids) - int(ids[-1:] == [self.end])
        inner = ids[start:stop]
        if self.begin in inner or self.end in inner:
            return self._decode_runs(ids)
        data = b"".join(map(surface.__getitem__, inner))
        if inner and self.kind[inner[0]] == NORMAL and self.text[inner[0]].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # ids that no text encodes to: bytes that form no character stand for U+FFFD each
            return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        out, run, begun = [], bytearray(), False

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in range(1, 5):
                    try:
                        out.append(bytes(run[i : i + n]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    n = 1
                i += n
            run.clear()

        for i in ids:
            if self.kind[i] == BYTE:
                run += self.surface[i]
                begun = True
                continue
            flush()
            if self.kind[i] == CONTROL:
                continue
            data = self.surface[i].decode()
            out.append(data[1:] if not begun and self.kind[i] == NORMAL and self.text[i].startswith(SPACE) else data)
            begun = True
        flush()
        return "".join(out)


class _Both(dict):
    """Words remembered from before, then those found just now."""

    def __init__(self, known: dict, found: dict):
        super().__init__(found)
        self.known = known

    def __missing__(self, word: str) -> bytes:
        return self.known[word]


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = model(path)
    for batch in batches:
        ids = pieces.encode([x or "" for x in batch.column(1).to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row, begin and end ids included."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(lambda b: _encoded(path, b), "doc_id long, ids array<int>")


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = model(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text from rows (doc_id, ids)."""
    bounded_batches(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(lambda b: _decoded(path, b), "doc_id long, text string")


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = model(path)
    for batch in batches:
        encoded = pieces.encode([x or "" for x in batch.column(1).to_pylist()])
        decoded = (pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in encoded)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        columns = [batch.column(0), pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array([sha(x) for x in encoded]), pa.array([sha(x.encode()) for x in decoded])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and of the text decoded from them. Encoding and decoding share one pass over the texts."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _digests(path, b), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
