"""Rows that are hard on plans rather than on rules: moved nulls, equal rows, hot keys, very long texts, and the paths for tables too large to
broadcast."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402

from shapespark.llm import chat, decontaminate, quality, secrets, shared, simhash  # noqa: E402
from shapespark.llm.queries import QUERIES  # noqa: E402

from . import brute  # noqa: E402


def test_row_keys_tell_moved_nulls_apart(spark):
    rows = [(1, None, "x", ["a", None], "s"), (1, "x", None, ["a", None], "s"), (1, "x", None, [None, "a"], "s"), (1, None, None, None, None), (1, "", None, [], None), (1, None, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, tags array<string>, source string")
    assert docs.select(*[k.alias(n) for k, n in zip(shared.row_keys(docs), "ab", strict=True)]).distinct().count() == len(rows)
    assert docs.unionByName(docs).select(shared.row_keys(docs)[0].alias("a")).distinct().count() == len(rows)


def test_running(spark):
    r = random.Random(2)
    rows = [([r.randint(0, 9) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 70_000)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", shared.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), shared.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(0)).alias("m")).collect()
    for v, s, m in got:
        total, most, sums, mosts = 0, 0, [], []
        for x in v:
            sums.append(total)
            mosts.append(most)
            total, most = total + x, max(most, x)
        assert (s, m) == (sums, mosts)


def test_join_counted(spark, monkeypatch):
    """Hot keys are broadcast, the others shuffled: the result is that of a plain join."""
    monkeypatch.setattr(shared, "HOT_FLOOR", 50)
    left = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    got = shared.join_counted(left, right, "k", "n", 1000)
    assert sorted(map(tuple, got.select("k", "id", "x").collect())) == sorted((0 if i < 400 else i % 97, i, 2 * (0 if i < 400 else i % 97)) for i in range(1000))


def test_components_of_a_large_star(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_FLOOR", 20)
    edges = [(5, i) for i in range(100, 900)] + [(i, i + 1) for i in range(2000, 2040)] + [(2040, 7), (3000, 3000)]
    got = {r.u: r.v for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 5 for i in range(100, 900)}, **{i: 7 for i in range(2000, 2041)}}


def test_secrets_of_a_long_text(spark):
    """Thousands of matches, of several kinds that overlap, take time in proportion, and are cut out at the right places."""
    r = random.Random(9)
    line = lambda: r.choice(("é" * r.randint(0, 9), "\U0001F600", "x y")) + " " + r.choice(("%032x" % r.getrandbits(128), "token=%030x" % r.getrandbits(120), "plain words", "secret: abcdefgh"))
    took = []
    for n in (500, 20_000):
        text = "\n".join(line() for _ in range(n))
        docs = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")
        began = time.time()
        clean = {d.doc_id: d.text for d in secrets.redact_secrets(docs).collect()}
        took.append(time.time() - began)
        for i, t in ((1, text), (2, text[: len(text) // 2])):
            spans = sorted((m.start(), m.end()) for rule in secrets.BASE for m in re.finditer(rule.pattern, t, re.A) if len(m[rule.group]) >= rule.least)
            out, at = [], 0
            for s, e in spans:
                if s >= at:
                    out += [t[at:s], "[secret]"]
                at = max(at, e)
            assert clean[i] == "".join(out) + t[at:]
    assert took[1] < 40 * max(took[0], 0.5) / 4  # 40 times the text


def test_secrets_with_many_candidates(spark, monkeypatch):
    """The same spans if candidates are too many to be broadcast, with equal rows among them."""
    docs = spark.createDataFrame([(i % 7, f"token=abcdef{i % 3}") for i in range(60)] + [(None, None), (1, "")], "doc_id long, text string")
    want = sorted(map(repr, secrets.secret_report(docs).collect()))
    monkeypatch.setattr(secrets, "CANDIDATE_BYTES", 1 << 40)
    assert sorted(map(repr, secrets.secret_report(docs.repartition(5)).collect())) == want


def test_postings_share_a_block():
    """Whichever two bytes differ, one of the choices of four positions is shared."""
    from itertools import combinations

    assert all(any(not set(b) & set(spoiled) for b in simhash.BLOCKS) for spoiled in combinations(range(8), 2))


@pytest.mark.parametrize("most", [1 << 16, 40])
def test_links_against_all_pairs(spark, monkeypatch, most):
    """Fingerprints around a few centres, in lists of all lengths, with crowded lists and with none."""
    monkeypatch.setattr(simhash, "LIST_MOST", most)
    monkeypatch.setattr(simhash, "CHUNK", 700)
    rng = np.random.default_rng(11)
    centres = rng.integers(-(1 << 63), 1 << 63, 6, dtype=np.int64)
    prints = {0, -1, 1, 3, 7}
    for c in centres.tolist():
        for bits in (16, 30, 64):
            for _ in range(90):
                flip = sum(1 << at for at in set(rng.integers(64 - bits, 64, rng.integers(0, 5)).tolist()))
                value = (c ^ flip) % (1 << 64)
                prints.add(value - (1 << 64) if value >> 63 else value)
    prints = sorted(prints)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= 2]
    root = simhash._local_roots(len(prints), np.array([i for i, _ in near]), np.array([j for _, j in near]))
    want = {p: prints[root[i]] for i, p in enumerate(prints)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    got = {r.u: r.v for r in shared.components(simhash.links(frame)).collect()}
    assert {p: got.get(p, p) for p in prints} == want


def test_keep_one_tells_rows_apart(spark, tmp_path, monkeypatch):
    """Rows that differ by a moved null, or not at all: one of each group stays, whether those that go are broadcast or not."""
    text = "some words that are the same in every one of these rows"
    rows = [(1, None, "x", "s", None), (1, "x", None, "s", None)] + [(2, text, "en", "s", i % 2) for i in range(9)] + [(None, text + " and more than that, much more", "en", None, 1), (3, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `_metadata` int")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    written = spark.read.parquet(str(tmp_path / "docs"))
    for size in (48, 1 << 40):
        monkeypatch.setattr(simhash, "GONE_BYTES", size)
        for frame in (docs, written):
            kept = simhash.keep_one(frame)
            assert kept.columns == docs.columns
            found = sorted(map(tuple, kept.collect()), key=repr)
            assert [r[:3] for r in found] == sorted([(1, None, "x"), (1, "x", None), (2, text, "en"), (None, text + " and more than that, much more", "en")], key=repr)


def test_contamination_of_long_and_repeated_texts(spark, monkeypatch):
    """Long documents, a preamble that all items share and equal rows, with tables broadcast and shuffled."""
    r = random.Random(3)
    words = [f"w{r.randint(0, 3000)}" for _ in range(60_000)]
    preamble = " ".join(words[:40])
    items = [(i, f"{preamble} {' '.join(words[200 * i : 200 * i + 30])}") for i in range(60)] + [(None, "w1 w2"), (7, ""), (8, None)]
    texts = [" ".join(words), " ".join(words[:35]), preamble, None, "", "w1 w2 w1 w2", *[f"{preamble} once more"] * 40]
    want = sorted(((i, *f) for i, f in enumerate(brute.contamination(texts, items))), key=repr)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    keep = [t for t, w in zip(texts, sorted(want, key=lambda x: x[0]), strict=True) if not w[5]]
    for size in (shared.BROADCAST_BYTES, -1):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", size)
        got = decontaminate.contamination(docs, bench, 10**6 if size > 0 else 0)
        assert sorted(map(tuple, got.collect()), key=repr) == want
        assert sorted((x.text for x in decontaminate.drop_contaminated(docs, bench).collect()), key=repr) == sorted(keep, key=repr)


def test_contamination_takes_linear_time(spark):
    """Words aren't copied for each fingerprint of a text."""
    took = []
    for n in (1_000, 100_000, 800_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{i * 7919 % 10007}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert decontaminate.contamination(docs, spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")).first().n_words == n
        took.append(time.time() - began)
    assert took[2] < 24 * max(took[1], 1)


def test_rejected_hosts_go(spark, monkeypatch):
    """A host whose documents mostly fail is rejected as a whole, also those that pass; its verdicts are broadcast or joined by salt."""
    words = " ".join(f"word{i}" for i in range(60))
    good = [(i, f"{words} {i}", f"good{i % 5}") for i in range(150)]
    bad = [(1000 + i, (f"{words} {i}" if i % 8 == 0 else f"short {i}"), None if i % 2 else "bad") for i in range(120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, source string").repartition(5)
    for size in (quality.BROADCAST_BYTES, -1):
        monkeypatch.setattr(quality, "BROADCAST_BYTES", size)
        rows = {r.doc_id: r for r in quality.quality(docs).collect()}
        assert len(rows) == 270
        assert {r.host for r in rows.values() if r.host_rejected} == {None, "bad"}
        assert all(rows[i].kept for i, _, _ in good) and not any(rows[i].kept for i, _, _ in bad)
        assert sum(not r.base_failed and not r.kept for r in rows.values()) == 15
        assert sorted(r.doc_id for r in quality.filter_quality(docs).collect()) == [i for i, _, _ in good]


def test_pipeline_after_a_rejected_host(spark, tmp_path):
    """What the stages make of documents of a rejected host, near copies, contaminated ones and secrets, down to the digests."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sentencepiece = pytest.importorskip("sentencepiece")
    import hashlib

    import public_tokenizers

    r = random.Random(6)
    body = lambda: " ".join(f"w{r.randint(0, 5000)}" for _ in range(80))
    clean = [(i, body(), "en", f"good{i % 4}") for i in range(60)]
    passage = " ".join(f"item{i}" for i in range(40))
    secret = (100, f"{(t := body())} password: hunter2222 é token=abcdefgh {t[:50]}", "en", "good1")
    rows = [
        *clean, *[(500 + i, "x y", "en", "bad") for i in range(80)], (700, body(), "en", "bad"),
        (60, clean[3][1], "en", "good2"), (None, clean[4][1], None, "good2"), (None, clean[4][1], None, "good2"), (101, passage + " " + body()[:300], "en", "good0"), secret,
    ]
    docs = spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, text, *_ in [*clean, (100, f"{t} [secret] é [secret] {t[:50]}")]:
        ids = model.encode(text, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(text)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_control_strings_are_escaped(spark):
    texts = ["#" * n + t for n in range(12) for t in ("", " assistant", "</turn>", "\\", "\\#")] + ["a#\\##b", "###" * 5000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in frame.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert back == t and "###" not in e and "</turn>" not in e


def test_deep_reply_trees(spark):
    """A chain far deeper than the rounds of the joins, with a better short branch and ties."""
    chain = [("t", i, i - 1 if i else None, "user" if i % 2 else "assistant", f"m{i}", 1.0) for i in range(600)]
    rows = [*chain, ("t", 900, 3, "user", "end", 50.0), ("u", 1, None, "user", "a", 0.0), ("u", 2, 1, "assistant", "b", 1.0), ("u", 3, 1, "assistant", "c", 1.0)]
    trees = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    got = {(r.tree[1:], r.leaf): r.formatted.count("</turn>") for r in chat.format_trees(trees, 2).collect()}
    assert got == {("t", 900): 5, ("t", 599): 600, ("u", 2): 2, ("u", 3): 2}
    assert chat.format_trees(trees.limit(0)).count() == 0


def test_empty_tables(spark, tmp_path):
    """Every operator on empty tables, and on tables with columns that may clash."""
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int, text string, score double, h long",
        "benchmark": "item_id long, text string, words string, mark long, length int, a long", "pages": "page_id long, url string, html string, payload string, sha1 string", "conversations": "conv_id long, turn long, role string, text string, tree string, id long",
    }
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op6_chat_format" else 0), name
