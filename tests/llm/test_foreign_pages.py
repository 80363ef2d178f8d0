"""Pages and archives as others write them: odd markup, formulas, records that are chunked, cut off or named otherwise."""

from __future__ import annotations

import gzip
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shapespark.llm import html_text, warc
from shapespark.llm.queries import QUERIES

from . import brute

BODY = "A long sentence about rivers, hills and towns, which goes on for a while. " * 4


def article(inner: str) -> str:
    return f"<html><body><noscript>Please enable scripts to see this site.</noscript><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title</h1><p>{BODY}{inner}<p>{BODY}</article><footer>&copy; x</footer>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds.", "E=mc2 holds."),
        ("<noscript>Shown without scripts, and part of the story.</noscript>", "Shown without scripts, and part of the story."),
        ("<object data=a>A map of the river.</object>", "A map of the river."),
        ('<a title="x>link</a> here.', "link here."),
        ('<a href="a>b" title=\'c "d"\'>link</a> here.', "link here."),
        ("<a href=/x/>link</a> and <b/>bold.", "link and bold."),
        ("three < four <5 <", "three < four <5 <"),
        ("<!-- left out > --><![CDATA[ so > is this ]]><!doctype x></ x>kept", "kept"),
        ("<!-- never closed>kept", "kept"),
    ],
)
def test_odd_markup(inner, text):
    kept = " ".join(BODY.split())
    assert html_text.main_texts(html_text.trained_model(), [article(inner)])[0] == f"Title {kept} {text} {kept}"


@pytest.mark.parametrize("unit", ['<a "', '<a x="', '<a x=">"', "<!", "<!--", "<p", "<script", "<b>", "<div>", "<i>x", "</p>", "<textarea>x", "<p x=\"'>"])
def test_linear_time(unit):
    """Markup that is never closed takes time in proportion."""
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        page = html_text.Page(unit * n)
        page.text(np.zeros(len(page.tag)))
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_empty_pages(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), tmp_path / "pages.parquet")
    for name in ("op8_warc", "op10_html_text"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0


CRLF = b"\r\n"


def foreign(kind: bytes, block: bytes, number: int, *more: bytes, length: int | None = None) -> bytes:
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:%032d>" % number, b"Content-Type: application/http; msgtype=response", *more, b"Content-Length: %d" % (len(block) if length is None else length)]
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


def test_foreign_archives(spark, tmp_path):
    payload = b"hello, world"
    sha1 = b"WARC-Payload-Digest: sha1:" + brute.base32(payload).encode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n7;x=y\r\n, world\r\n0\r\n\r\n"
    records = [
        foreign(b"response", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload, 1, sha1),
        foreign(b"response", chunked, 2, sha1),
        foreign(b"response", b"HTTP/1.1 200 OK\r\nServer: no empty line", 3),
        foreign(b"revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n", 4, sha1, b"WARC-Refers-To: <urn:uuid:%032d>" % 1),
        foreign(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n", 5),
        foreign(b"response", b"HTTP/1.1 200 OK\r\nX: a\r\n b\r\nContent-Length: nonsense\r\n\r\n" + payload, 6, b"WARC-Target-URI: http://a/" + b"y" * 200_000, sha1),
        foreign(b"warcinfo", b"software: x", 7).replace(b"application/http; msgtype=response", b"application/warc-fields"),
        foreign(b"response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nnot chunked", 8),
        foreign(b"response", b"HTTP/1.1 200 OK\r\n\r\n" + payload, 9).replace(b"%032d" % 9, b"page:zz"),
    ]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(records))
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    path = "file://" + str(folder)
    rows = warc.read_warc(spark, path, verify=True).collect()
    assert len(rows) == 2 * len(records) and all(r.page_id is None and r.refers_to is None for r in rows)
    by = {int(r.record_id[-33:-1]): r for r in rows if r.record_id[-33:-1].isdigit()}
    assert [(by[n].payload_bytes, by[n].payload) for n in (1, 2, 3, 4, 5, 6, 7, 8)] == [(12, payload), (12, payload), (0, b""), (12, None), (None, None), (12, payload), (11, b"software: x"), (11, b"not chunked")]
    assert by[4].refers_to_id == "<urn:uuid:%032d>" % 1
    light = {r.record_id: r.payload_bytes for r in warc.read_warc(spark, path, payload=False).collect()}
    assert light == {r.record_id: r.payload_bytes for r in rows}
    assert warc.read_warc(spark, path, payload=False).filter(F.col("record_id") == "<urn:uuid:%032d>" % 2).count() == 2


def test_archives_that_are_cut_off(spark, tmp_path):
    whole = foreign(b"response", b"HTTP/1.1 200 OK\r\n\r\nall of it", 1)
    (tmp_path / "a.warc").write_bytes(whole + whole[:-8])
    path = "file://" + str(tmp_path)
    assert sorted(r.payload for r in warc.read_warc(spark, path).collect()) == [b"all o", b"all of it"]
    with pytest.raises(Exception, match="ends inside the record"):
        warc.read_warc(spark, path, verify=True).collect()
    (tmp_path / "a.warc").write_bytes(whole + b"no record")
    with pytest.raises(Exception, match="not the start"):
        warc.read_warc(spark, path).collect()
