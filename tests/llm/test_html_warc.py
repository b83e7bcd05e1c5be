"""Main text and web archives: hand-made pages, the given pages by their template, and damaged archives."""

import time
import base64
import gzip
import hashlib
import html
import random
import re

import pytest
from pyspark.sql.types import LongType

from graticule.llm import htmltext, warc
from graticule.llm.common import scratch_path, table

SF_DIR = "/root/testdata/sf0.01"

PAGES = {
    "<body><nav><a href=x>Menu</a></nav><article><header><h1>Title</h1></header><p>One  two\n three.<p>Four &amp; f&eacute;</article><footer>end</footer>": "Title\nOne two three.\nFour & fé",
    "<html><body><div class='side-bar sidebar'>links</div><div id=content><p>" + "Long text here. " * 20 + "</p><p>Short.</p></div><div class=comments><p>" + "I think so. " * 20 + "</p></div>": "Long text here. " * 19 + "Long text here.\nShort.",
    "<article>A<script>var x='</p>';</script>B<style>p{}</style><!-- no --><div class='ad'>buy</div>C</article>": "AB\nC",
    "<article><p>x &lt;b&gt; y</p><form>name <input></form><aside>see also</aside><p>z</article>": "x <b> y\nz",
    "<main><div class='post-header'><h2 class=header>Head</h2></div><p>Body</p><section id='reader-comments'>No!</section></main>": "Head\nBody",
    "<p>plain page without structure": "plain page without structure",
    "": "", "   ": "", "<nav>only a menu</nav>": "", "<article><p>cut off in a ta<b": "cut off in a ta",
    "<article><p>cut off in a menu</p><div class=menu>a<p>b": "cut off in a menu",
    "<div class=ad>never closed <article><p>text</p></article>": "text",
    "text with a &lt;sign &#233; &nbsp; 3 < 4 > 2": "text with a <sign é 3 < 4 > 2",
    "<ul><li><a href=a>one link</a><li><a href=b>two link</a></ul>" + "<nav>x</nav>" + "<p>" + "words in a row " * 9 + "</p>": ("words in a row " * 9).strip(),
}


@pytest.mark.parametrize("page", list(PAGES))
def test_hand_made_pages(page):
    assert htmltext.main_text(page) == PAGES[page]


LONG, SHORT = "Long text here. " * 30, "Short."
MARKED = {
    f"<article><p>teaser</p></article><div><p>{LONG}</p></div>": LONG.strip(),  # by density, not by the tag
    f"<main><h1>Head</h1><article><p>{LONG}</p><div class=ad>buy</div><p>{SHORT}</p></article></main>": f"Head\n{LONG.strip()}\n{SHORT}",
    f"<article><p>{LONG}</p></article><div class=comments><article><p>{LONG}</p></article></div>": LONG.strip(),
    f"<div class=ad>never closed <article><div>{LONG}</div></article>": LONG.strip(),
    f"<div><div class=ad>closed by another <article><p>{LONG}</p></article></div>": LONG.strip(),
}


@pytest.mark.parametrize("page", list(MARKED))
def test_density_decides_on_marked_pages(page):
    assert htmltext.main_text(page) == MARKED[page]


def test_given_pages_by_their_template(spark):
    def template(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"<[a-z/][^>]*$", "", inner))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in parts]
        return "\n".join(b for b in blocks if b)

    pages = table(spark, SF_DIR, "pages")
    rows = htmltext.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    for r in rows:
        assert r.text == template(r.html) and r.n_chars == len(r.text)


def test_surges_and_dives():
    assert htmltext.stretches(htmltext.np.array([0, 0, 5, 5, 0, 0, 0, 7, 0])) == [(2, 6), (7, 9)]


def odd_pages(spark):
    rows = [
        (3, "http://a", "<p>same"), (1, "http://b\r\nX: y", "<p>same"), (2, None, "<p>same"), (4, "u", None), (5, "u", ""), (None, "u", "<p>same"),
        (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), (7, "u", "é" * 50000), (7, "u", "é" * 50000), (8, "u", "\x00\r\n\r\nWARC/1.0\r\n"),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id bigint, url string, html string, digest string, first int, n int")


def test_awkward_pages(spark):
    rows = {(r.page_id, r.url): r for r in htmltext.extract(odd_pages(spark)).collect()}
    assert rows[4, "u"].text == "" and rows[3, "http://a"].text == "same" and rows[7, "u"].n_chars == 50000
    assert htmltext.extract(odd_pages(spark).where("false")).count() == 0


@pytest.mark.parametrize("least", [0, 8])
def test_archives_round_trip(spark, least):
    pages = odd_pages(spark)
    rows = warc.roundtrip(pages, least_bytes=least).collect()
    given = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in given:
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    wanted = []
    for i, p in given:
        again = i is not None and first.get(p, i) != i
        wanted.append((i or -1, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else -1))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in rows) == sorted(wanted)
    assert warc.roundtrip(pages.where("false")).count() == 0


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000, raising=False)
    sizes = [10, 150, 1000, 10_000, 60_000, 90_000, 300_000]
    rows = [(k, "http://a", str(k).rjust(6, "x") * (n // 6)) for k, n in enumerate(sizes * 12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "warc-bytes")
    warc.write(pages, path)
    lengths = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert max(lengths) < 302_000  # the longest record, or 200,000 bytes and headers
    found = {int(r.page_id): (r.record_type, bytes(r.payload).decode()) for r in warc.read(spark, path).collect()}
    assert found == {k: ("response", t) for k, _, t in rows}


def record(n, payload=b"text", extra=b""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    return (
        b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nWARC-Payload-Digest: sha1:%s\r\n%sContent-Type: application/http\r\n"
        b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (n, digest, extra, len(block), block)
    )


def found(data):
    whole = list(warc.salvage(data))
    return [int(f["x-page-id"]) for _, _, problem, f, _ in whole if problem is None], [(a, n) for a, n, problem, _, _ in whole if problem]


def test_salvage_of_plain_archives():
    parts = [record(k, b"p%d" % k * 30) for k in range(5)]
    data = b"".join(parts)
    at = [sum(map(len, parts[:k])) for k in range(6)]
    assert found(data) == ([0, 1, 2, 3, 4], [])
    flipped = bytearray(data)
    flipped[at[2] - 20] ^= 1  # in the payload of record 1
    assert found(bytes(flipped)) == ([0, 2, 3, 4], [(at[1], at[2] - at[1])])
    assert found(data[: at[4] + 50]) == ([0, 1, 2, 3], [(at[4], 50)])
    assert found(b"junk" + data) == ([0, 1, 2, 3, 4], [(0, 4)])
    long = data.replace(b"Content-Length: 79", b"Content-Length: 99", 1)
    assert found(long)[0] == [1, 2, 3, 4]
    inner = record(7, b"WARC/1.0\r\n" + record(8))
    assert found(record(6) + inner + record(9)) == ([6, 7, 9], [])
    assert found(b"") == ([], []) and found(b"\r\n\r\n") == ([], [])


def test_salvage_of_compressed_archives():
    members = [gzip.compress(record(k, random.Random(k).randbytes(200)), mtime=0) for k in range(5)]
    data = b"".join(members)
    at = [sum(map(len, members[:k])) for k in range(6)]
    assert found(data) == ([0, 1, 2, 3, 4], [])
    broken = bytearray(data)
    broken[at[2] + 60 : at[2] + 70] = b"\x00" * 10
    assert found(bytes(broken)) == ([0, 1, 3, 4], [(at[2], at[3] - at[2])])
    assert found(data[: at[3] + 30]) == ([0, 1, 2], [(at[3], 30)])
    whole = gzip.compress(b"".join(record(k) for k in range(3)))
    assert found(whole + record(3)) == ([0, 1, 2, 3], [])


def test_limits_of_members():
    data = gzip.compress(record(1, b"x" * 5000)) + gzip.compress(record(2))
    kinds = [(f.get("x-page-id"), problem) for _, _, problem, f, _ in warc.salvage(data, most=1000)]
    assert kinds == [(None, "member inflates beyond the limit"), ("2", None)]
    nested = gzip.compress(gzip.compress(record(3) * 9) * 2, mtime=0)
    assert found(nested + record(4))[0][-1] == 4 and found(nested)[1][0][0] == 0  # members in a member are not opened
    assert found(record(5) + b" \n" + record(6)) == ([5, 6], [])  # white space is no gap


@pytest.mark.parametrize(
    "piece",
    [
        gzip.compress(record(1, random.Random(1).randbytes(9000)), mtime=0),
        record(1, random.Random(1).randbytes(9000)).replace(b"WARC-Type", b"WARC-Typo"),
        b"WARC/1.0\r\n" + b"x: y\r\n" * 1000,
        b"junk \n" + record(1, random.Random(1).randbytes(9000)),
        warc.MEMBER + b"\x00" * 9000,
    ],
)
def test_salvage_takes_linear_time(piece):
    def seconds(n):
        began = time.process_time()
        assert sum(1 for _ in warc.salvage(piece * n)) >= 1
        return time.process_time() - began

    seconds(50)
    assert seconds(4000) < 24 * max(seconds(500), 0.02)


def test_a_gap_in_own_archives_fails(spark):
    gap = spark.createDataFrame([("f", 5, "cut off", None, None, None, None, None)], "file string, offset long, problem string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    with pytest.raises(Exception, match="gap in f at 5: cut off"):
        warc.records_only(gap, LongType()).select("payload_bytes").collect()


def test_gaps_are_reported_with_their_file(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>page {k}") for k in range(20)], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write(pages, path)
    files = spark.read.format("binaryFile").load(path).where("length > 0").orderBy("path").collect()
    local = files[0]["path"].removeprefix("file:")
    data = bytearray(files[0]["content"])
    data[data.index(b"Content-Length")] = 0x58
    with open(local, "wb") as file:
        file.write(data)
    import os

    os.remove(os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.crc"))
    rows = warc.read(spark, path).collect()
    gaps = [r for r in rows if r.problem]
    assert len(gaps) == 1 and gaps[0].file == files[0]["path"] and gaps[0].problem == "no content length"
    assert sorted(int(r.page_id) for r in rows if not r.problem) == sorted({*range(20)} - {int(re.search(rb"X-Page-ID: (\d+)", data)[1])})
    assert all(bytes(r.payload) == f"<p>page {r.page_id}".encode() for r in rows if not r.problem)


LONG = "Words of a long paragraph that go on and on, as an article's do, until there are enough of them. "


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<p title="a"b">Hello world</p>', "Hello world"),
        ("<p>One</p><a href=x title=it's>two</a><p>three</p><p>it's four</p>", "One\ntwo\nthree\nit's four"),
        ('<h2 id="related-work">Related work</h2><p>a</p><h2 id="search">Search</h2><p>b</p>', "Related work\na\nSearch\nb"),
        ('<p class="form-factor">Size</p><section class="notice-period"><p>Weeks</p></section>', "Size\nWeeks"),
        ('<p>Before <span class="share">Share</span> after</p>', "Before after"),
        ("<p>Let <math><mi>x</mi></math> be</p>", "Let x be"),
        ('<p>a</p><div class="ad-slot">Buy</div><div id="cookieBanner">Ok</div><p>b</p>', "a\nb"),
        ('<p data-x="1>2">c</p>', "c"),
        ("<p title='never closed>d</p><p>e</p>", "d\ne"),
        ("<p title = 'x > y' class=\"big\">f</p>", "f"),
    ],
)
def test_attributes_lose_no_text(inner, text):
    page = f"<html><body><nav><a href=/>Menu</a></nav><article><p>{LONG * 5}</p>{inner}</article></body></html>"
    assert htmltext.main_text(page) == f"{(LONG * 5).strip()}\n{text}"


@pytest.mark.parametrize("piece", ['<a x="', "<a x='", "<a x=' y=\"", "<", "<a ", '"', "<p title=\"a\"b\">c", "=", "<a x==\"'"])
def test_unclosed_quotes_take_linear_time(piece):
    began = time.perf_counter()
    htmltext.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 10
