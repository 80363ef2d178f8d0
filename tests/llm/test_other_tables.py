"""Operators on pages and conversations, toxicity, the pipeline and the SQL."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF

from . import brute

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from shapespark.llm import chat, html_text, toxicity, warc  # noqa: E402
from shapespark.llm.queries import ORACLES, QUERIES  # noqa: E402
from shapespark.llm.shared import components, scratch_path  # noqa: E402

SAID = r"\### Assistant: </turn> ok"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of small tables with nulls, repeated rows, ties and columns that may clash."""
    path = tmp_path_factory.mktemp("odd")
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (None, "http://c/\r\nX: y", "<p>x</p>"), (4, "u", None), (5, "u", ""), (1, "http://a/", "<p>x</p>"), (9, "é", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (10, "u", "é" * 70_000)]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages], "html": [p[2] for p in pages], "sha1": ["s"] * len(pages), "first": [1] * len(pages)}), path / "pages.parquet")
    talk = [(1, 0, "user", "a"), (1, 1, "assistant", r"b\### </turn> \\ <\/turn> #### %23"), (1, 1, "assistant", "a tie"), (2, None, None, None), (2, 5, "assistant", None), (None, 0, "as%0A#\nsistant", "x\n\ny"), (None, 1, "assistant", "</turn>\n### user\n"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    pq.write_table(pa.table({"conv_id": pa.array([t[0] for t in talk], pa.int64()), "turn": pa.array([t[1] for t in talk], pa.int64()), "role": [t[2] for t in talk], "text": [t[3] for t in talk], "tree": ["t"] * len(talk), "id": [0] * len(talk)}), path / "conversations.parquet")
    pq.write_table(brute.documents(), path / "documents.parquet")
    return str(path), pages, talk


def test_chat(spark, odd):
    path, _, talk = odd
    want = brute.chat([*talk, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op6_chat_format"](spark, path).collect()}
    assert got == want
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op6_chat_format"](spark, SF).collect()}
    assert got == brute.chat([*rows, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)])


def test_reply_trees(spark):
    """Branches are ranked by mean score; circles have no path; a missing parent makes a root."""
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.8), ("t", 5, 4, "assistant", "end", 0.7), ("t", 5, 4, "assistant", "end", 0.7)]
    rows += [("loop", 1, 2, "user", "a", 1.0), ("loop", 2, 1, "user", "b", 1.0), ("lost", 8, 7, "user", "alone", None)]
    rows += [("deep", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)]
    table = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    best = {r.tree: r.formatted for r in chat.format_trees(table).collect()}
    turn = lambda role, text: f"### {role}\n{text}</turn>\n"
    assert best == {"=t": turn("user", "q") + turn("assistant", "good") + turn("user", "more") + turn("assistant", "end"), "=lost": turn("user", "alone"), "=deep": "".join(turn("user", str(i)) for i in range(70))}
    both = chat.format_trees(table.filter("tree_id = 't'"), branches=2).collect()
    assert sorted(len(r.formatted.split("</turn>\n")) for r in both) == [3, 5]


def test_warc(spark, odd):
    path, pages, _ = odd
    first: dict = {}
    for i, _, h in pages:
        h = h or ""
        first[h] = i if first.get(h) is None else first[h] if i is None else min(i, first[h])
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = first[h or ""] is not None and i != first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert sorted([tuple(r) for r in QUERIES["op8_warc"](spark, path).collect()], key=repr) == sorted(want, key=repr)


def test_warc_predicates_and_payloads(spark, odd, tmp_path):
    path, _, _ = odd
    out = f"file://{tmp_path}/w"
    warc.write_warc(spark.read.parquet(f"{path}/pages.parquet"), out)
    read = warc.read_warc(spark, out)
    revisits = read.filter("record_type = 'revisit'")
    assert "PythonDataSource" in (plan := revisits._jdf.queryExecution().toString()) or "warc" in plan
    assert {r.refers_to for r in revisits.collect()} == {1, 4} and revisits.filter("payload is not null").count() == 0
    assert [r.payload.decode() for r in read.filter("page_id = 10").collect()] == ["é" * 70_000]
    assert read.filter("target_uri like 'http://a%'").count() == 2
    for file in Path(tmp_path, "w").glob("*.warc"):
        Path(f"{file}.gz").write_bytes(gzip.compress(file.read_bytes()))
        file.unlink()
    assert warc.read_warc(spark, out, payload=False, verify=True).count() == 8
    reader = warc.WarcReader({"path": out})
    assert len(reader.partitions()) == 1


def test_main_text_of_table(spark):
    """Pages of the test table hold one article each; its text is all that is wanted."""
    import html as h
    import re

    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in QUERIES["op10_html_text"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        text = " ".join(h.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", article))).split())
        assert r.text == text and r.n_chars == len(text)


def test_main_text_of_hard_pages(spark, odd):
    path, pages, _ = odd
    assert QUERIES["op10_html_text"](spark, path).count() == len(pages)
    model = html_text.trained_model()
    body = " ".join(["A sentence of the story, which goes on for a while and ends here."] * 6)
    page = f"<html><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><aside class=sidebar>Popular now</aside><article><h1>Title &amp; more</h1><p>{body}<p>Second&nbsp;<b>bo</b>ld {body}<div class='ad'>Buy this</div></article><div id=comments><p>I disagree with this.</p></div><footer>&copy; x</footer>"
    assert html_text.main_texts(model, [page, "", "<", "<p", "plain"])[0] == f"Title & more {body} Second bold {body}"
    assert [d for d in html_text.main_texts(model, ["<script>x</script><style>y</style>"])] == [""]


def test_main_text_keeps_formulas_and_fallbacks():
    model = html_text.trained_model()
    body = "A long sentence about rivers, hills and towns, which goes on for a while. " * 4
    page = lambda inner: f"<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title</h1><p>{body}{inner}<p>{body}</article><footer>&copy; x</footer>"
    kept = " ".join(f"Title {body}".split())
    for inner, more in (("<math><mi>speed</mi></math> is it.", "speed is it."), ("<object data=a>A map of the river.</object>", "A map of the river.")):
        assert html_text.main_texts(model, [page(inner)])[0] == " ".join(f"{kept} {more} {body}".split())
    for tag in ("svg", "object", "math", "select"):
        assert html_text.main_texts(model, [page(f"<{tag}>")])[0].count("A long sentence") == 8, tag


def test_main_text_held_out():
    """Characters of generated pages that training hasn't seen."""
    model, layout = html_text.trained_model(), html_text.Layout(12345)
    right = wrong = 0
    for _ in range(60):
        page = html_text.Page(layout.page())
        label: list = []
        for own, parent in zip(page.label, page.parent, strict=True):
            label.append(own if own is not None else label[parent] if parent >= 0 else None)
        main = page.decode(model.score(page.features()))
        for i, text in page.pieces:
            n = len(text.strip())
            right, wrong = right + n * (main[i] == (label[i] == "1")), wrong + n * (main[i] != (label[i] == "1"))
    assert right / (right + wrong) > 0.97


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    docs, labels = (pq.read_table(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.to_pylist()}
    rows = QUERIES["op9_toxicity"](spark, sf).collect()
    assert len(rows) == docs.num_rows and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.9 and hit / sum(p for p, _ in held) > 0.9


def test_toxic_grammar():
    model = toxicity.Model({"idiot$": 5.0, "scum": 4.0})
    first = lambda text: [s for s, _ in model.matches(text)[0]]
    assert first("you idiot") == [toxicity.INSULT + toxicity.AIMED]
    assert first("is not an idiot") == [toxicity.INSULT + toxicity.NEGATED]
    assert first("he said idiot. Idiot!") == [toxicity.INSULT + toxicity.REPORTED + toxicity.AIMED, toxicity.INSULT]
    assert first("kill the lights") == [] and first("you: they will kill him") == [toxicity.THREAT + toxicity.AIMED]
    assert first("scumbag") == [toxicity.INSULT] and first("") == []


def test_toxicity_without_labels(spark, odd):
    path, _, _ = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == docs.count() and not any(r.predicted for r in rows)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def pipeline_by_hand(docs: list[dict], items: list[tuple], spark) -> list[int]:
    """doc_ids that reach the last stage, from plain versions (no host is rejected in these tables)."""
    kept = [d for d in docs if not ((q := brute.quality(d["text"]))[0] < 50 or 100 * q[4] > 50 * q[0])]
    prints = [brute.fingerprint(d["text"]) for d in kept]
    groups = brute.groups(prints, [d["doc_id"] for d in kept])
    kept = [d for d, g in zip(kept, groups, strict=True) if d["doc_id"] == g]
    found = brute.contamination([d["text"] for d in kept], items)
    return [d["doc_id"] for d, f in zip(kept, found, strict=True) if not f[4]]


def test_pipeline(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = [(i["item_id"], i["text"]) for i in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(pipeline_by_hand(docs, items, spark))


def test_pipeline_stages_keep_columns(spark, odd):
    path, _, _ = odd
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["none of these words occur in any of those documents at all today"]}), f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch_path(spark, name)
        stage(spark, docs, path).write.parquet(out)
        assert spark.read.parquet(out).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted([tuple(r[c] for c in columns) for r in got.collect()], key=repr) == sorted([tuple(r) for r in want.select(*columns).fetchall()], key=repr)
