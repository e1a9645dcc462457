import hashlib
import struct
import time
import zlib
from html.parser import HTMLParser

import pytest

from cellgrove.llm import html_text, matroska, queries
from cellgrove.llm.common import table
from tests.conftest import SF


@pytest.mark.parametrize("lacing", ["auto", "none", "xiph", "ebml"])
@pytest.mark.parametrize("size", [64, 1024, 1088, 8192, 131072, 131136, 300032])
def test_round_trip(lacing, size):
    payload = bytes(i * 7 % 251 for i in range(size))
    media = matroska.write_matroska(payload, lacing)
    parsed = matroska.read_matroska(media)
    assert matroska.read_payload(media) == payload
    assert parsed["tracks"][1] == {"number": 1, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "bits": 8}
    assert len(parsed["cues"]) == 1 + max(p[0] for p in parsed["packets"])
    for time, _, where in parsed["cues"]:
        assert media[where : where + 4] == bytes.fromhex("1f43b675") and any(p[2] == time for p in parsed["packets"])
    times = [p[2] for p in parsed["packets"]]
    assert times == sorted(times)


def test_unknown_sizes_and_block_groups():
    group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, matroska._block(1, 5, [b"abc"], "none")) + matroska._uint(matroska.REFERENCE, 1))
    body = matroska._uint(matroska.TIMESTAMP, 7) + group
    cluster = matroska._id(matroska.CLUSTER) + b"\xff" + body
    media = matroska.HEAD + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska.TRACK_ENTRY + cluster + cluster
    parsed = matroska.read_matroska(media)
    assert [p[:3] for p in parsed["packets"]] == [(0, 1, 12_000_000), (1, 1, 12_000_000)] and not parsed["packets"][0][5]
    assert matroska.read_payload(media) == b"abcabc"


def timed(codec, extra=b"", duration=None, rate=8000.0, channels=2, bits=16):
    """Timestamps in ms of a block of four laced frames of 32 bytes at 10 ms."""
    m = matroska
    audio = m._element(m.AUDIO, m._float(m.SAMPLING, rate) + m._uint(m.CHANNELS, channels) + m._uint(m.BIT_DEPTH, bits))
    track = m._element(m.TRACKS, m._element(m.TRACK, m._uint(m.TRACK_NUMBER, 1) + m._element(m.CODEC, codec) + extra + audio))
    group = m._element(m.BLOCK, m._block(1, 10, [bytes(32)] * 4, "auto")) + (b"" if duration is None else m._uint(m.BLOCK_DURATION, duration))
    cluster = m._element(m.CLUSTER, m._uint(m.TIMESTAMP, 0) + m._element(m.BLOCK_GROUP, group))
    where = lambda number, at: m._element(m.CUE_POSITIONS, m._uint(m.CUE_TRACK, number) + m._uint(m.CUE_CLUSTER, at))
    cues = m._element(m.CUES, m._element(m.CUE, m._uint(m.CUE_TIME, 10) + where(1, 5) + where(2, 6)))
    parsed = m.read_matroska(m.HEAD + m._element(m.SEGMENT, track + cluster + cues))
    assert [(t, n, at - parsed["cues"][0][2]) for t, n, at in parsed["cues"]] == [(10_000_000, 1, 0), (10_000_000, 2, 1)]
    return [p[2] / 1e6 for p in parsed["packets"]]


def test_times_of_laced_frames():
    assert timed(b"A_PCM/INT/LIT") == [10, 11, 12, 13]  # 32 bytes are 8 samples of 2 x 16 bits
    assert timed(b"A_PCM/INT/LIT", channels=1, bits=8) == [10, 14, 18, 22]
    assert timed(b"A_OPUS", matroska._uint(matroska.DEFAULT_DURATION, 20_000_000)) == [10, 30, 50, 70]
    assert timed(b"A_OPUS", matroska._uint(matroska.DEFAULT_DURATION, 20_000_000), duration=40) == [10, 20, 30, 40]
    assert timed(b"A_OPUS") == [10, 10, 10, 10]  # nothing tells how long a frame lasts


def test_digests(spark, odd, none):
    found = {r.doc_id: r for r in matroska.media_digests(odd).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        got = found[r.doc_id]
        assert (got.n_bytes, got.payload_bytes) == (len(raw), len(payload)) and got.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got.tail_crc32 == zlib.crc32(payload[-64:]) and got.media_bytes > got.payload_bytes
    assert matroska.media_digests(none).count() == 0


def test_packet_table(spark, odd):
    media = matroska.to_media(odd, "text", "doc_id")
    packets = matroska.packet_table(media, "media", "doc_id")
    assert packets.filter("error is not null").count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None), (3, bytearray(matroska.HEAD)), (4, bytearray(matroska.write_matroska(bytes(64))[:-9]))], "doc_id long, media binary")
    assert [r.error is not None for r in matroska.packet_table(bad, "media", "doc_id").orderBy("doc_id").collect()] == [True] * 4
    assert struct.calcsize(">hB") == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a><li>Other</ul></nav><div class="cookie-notice">We use cookies</div><header>Site</header>
<article><h1>A &amp; B</h1><p>One <b>two</b>
three<p>Four&nbsp;five<br>six<div class="share">Share this</div><ul><li>x<li>y</ul><form><input><p>Form</form><section class="comments"><p>A reader's comment</section></article>
<aside>Side</aside><div class='ad'>Buy</div><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_text.Page(PAGE).text().split("\n") == ["A & B", "One two three", "Four five six", "Share this", "x", "y"]  # inside an article only counts find boxes
    assert html_text.Page("<p>no article<p>here").text() == "no article\nhere"
    assert html_text.Page("<main>kept</main>dropped").text() == "kept"
    assert html_text.Page("<div class=page-header>Site</div><article><div class='entry-header'><h2>Own</h2></div><p class=ad-box>Ad</p>x</article>").text() == "Own\nx"
    assert html_text.Page("plain").text() == "plain" and html_text.Page("<p").text() == "<p"
    assert html_text.Page("<article>a < b &lt;c&gt; &amp;amp; &unknown;</article>").text() == "a < b <c> &amp; &unknown;"


def test_templates_of_a_site_go(spark, none):
    body = lambda i: f"<div><p>Every page has this</p></div><div><p>Text of page {i}</p></div>"
    rows = [(i, f"http://www.site.org/{i}", body(i)) for i in range(8)] + [(100, "http://other.org/", body(100)), (101, None, None), (102, "x", ""), (None, "http://www.site.org/n", body("n")), (3, "http://www.site.org/3", body(3))]
    rows += [(200 + i, "http://copies.org/", "<article><p>The same article</p></article>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert all(found[i] == f"Text of page {i}" for i in range(8))
    assert found[100] == "Every page has this\nText of page 100" and found[101] == "" and found[102] == ""
    assert all(found[200 + i] == "The same article" for i in range(9))
    assert html_text.main_text(pages).count() == len(rows)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_wrapped_articles_stay(spark):
    """An element around the article is no template, though all of it but the article recurs, or all of it does."""
    page = lambda x: f"<div id=page><p>Same</p><section><article><p>Text {x}</p></article></section></div><p>Left over</p>"
    rows = [(i, "http://a.org/", page(i)) for i in range(9)] + [(100 + i, "http://copies.org/", page("copied").replace("article", "main")) for i in range(9)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Text {i}" and found[100 + i] == "Text copied" for i in range(9))


def test_templates_inside_articles_go(spark):
    """A box that recurs in many different articles, in main or article, goes; copies of an article keep it and their text."""
    box = "<div class=join-us><p>Join our <b>club</b> today</p></div>"
    rows = [(i, "http://a.org/", f"<article><p>Text <b>of</b> {i}</p>{box}</article>") for i in range(9)]
    rows += [(100 + i, "http://b.org/", f"<main>{box}<div><p>Text <b>of</b> {i}</p></div></main>") for i in range(9)]
    rows += [(200 + i, "http://copies.org/", f"<div>{i}</div><article><p>Copy</p>{box}</article>") for i in range(9)]
    rows += [(300 + i, "http://few.org/", f"<article><p>Text of {i}</p>{box if i < 2 else ''}</article>") for i in range(9)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k + i] == f"Text of {i}" for k in (0, 100) for i in range(9))
    assert all(found[200 + i] == "Copy\nJoin our club today" for i in range(9))
    assert found[300] == "Text of 0\nJoin our club today" and found[308] == "Text of 8"


def test_templates_under_neutral_names(spark):
    """Only the counts can tell these boxes from the text; a page given five times is one page."""
    page = lambda i: f"<div class=a1><p>Home of {'many' if i % 2 else 'all'} things</p></div><div class=b2><p>Text {i} begins</p><p>and ends {i}.</p></div><div class=c3>Last words</div>"
    rows = [(i, "http://a.org/", page(i)) for i in range(12)]
    rows += [(100 + i, "http://b.org/", page(100 + i % 10 if i < 10 else 100)) for i in range(14)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Text {i} begins\nand ends {i}." for i in range(12))
    assert all(found[100 + i] == f"Text {100 + i} begins\nand ends {100 + i}." for i in range(10)) and all(found[110 + i] == found[100] for i in range(4))


def test_near_copies_of_articles_keep_their_text(spark):
    """Articles that share most of their paragraphs are copies of one another, not pages of one template."""
    page = lambda i: "<article>" + "".join(f"<p>Paragraph {k} of the article{' and more ' + str(i) if k == i % 5 else ''}.</p>" for k in range(8)) + "</article>"
    found = [r.text for r in html_text.main_text(spark.createDataFrame([(i, "http://a.org/", page(i)) for i in range(20)], "page_id long, url string, html string")).collect()]
    assert all(len(t.split("\n")) == 8 for t in found)


def test_odd_markup():
    text = lambda s: html_text.Page(s).text()
    assert text("<article><p title=it's>one</p><p class=legal>two</p><p>it's three</article>") == "one\ntwo\nit's three"
    assert text("<main><h1>Title</h1><p>Intro</p><article>card</article></main>") == "Title\nIntro\ncard"
    assert text('<p title="x>y</p>abc') == "y\nabc" and text("<p a='>'b>x") == "x" and text("<p =a b==c>x<br/>y</p/>z") == "x y\nz"
    assert text("</>a</ b><3 <!x>c<?y>d<!--e>f-->g<!--h") == "a<3 cdg"
    for page in ("<a " * 350_000, "<b><hr>" * 150_000, "<p><object>" + "<b><hr>" * 100_000, "<script>" + "</script " * 100_000, "<div>" * 100_000 + "x", "<i a='" * 100_000, "</b" * 300_000, "<" * 500_000):
        began = time.perf_counter()
        text(page)
        assert time.perf_counter() - began < 10, page[:20]


class Reference(HTMLParser):
    """Texts of the article by the library's parser: blocks of h1 and p, nothing else stands in the test pages' articles."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("h1", "p"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)


def test_query_on_all_pages(spark):
    found = {r.page_id: r for r in queries.op9_html(spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(found) == len(pages)
    for p in pages:
        assert found[p.page_id].text == Reference(p.html).text() and found[p.page_id].n_chars == len(found[p.page_id].text)


def test_pages_odd_rows(spark):
    page = lambda i: f"<div>Recurs</div><div>Own {i}</div>"
    rows = [(None, "http://a.org/", page(i)) for i in range(4)] + [(7, "http://a.org/", page(i)) for i in range(4, 8)] + [(7, "http://a.org/", page(7)), (8, None, None), (8, "http://a.org/", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS host", "3 AS _template", "4 AS _html", "5 AS body", "6 AS text")
    found = sorted((str(r.page_id), r.text[:9]) for r in html_text.main_text(df).collect())
    assert found == sorted([("None", f"Own {i}") for i in range(4)] + [("7", f"Own {i}") for i in (4, 5, 6, 7, 7)] + [("8", ""), ("8", "long long")])


def test_media_query(spark):
    """Every column of the query, the feature too, from the bytes."""
    rows = table(spark, SF, "documents").collect()
    found = {r.doc_id: r for r in queries.op8_media(spark, SF).collect()}
    assert len(found) == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        got, media = found[r.doc_id], matroska.write_matroska(payload)
        assert (got.media_sha256, got.media_bytes, got.n_bytes) == (hashlib.sha256(media).hexdigest(), len(media), len(raw))
        said = dict(x.split("=") for x in got.feature.split(";"))
        high = [b >= 128 for b in payload]
        assert int(said["sum"]) == sum(payload) and int(said["step2"]) == sum((a - b) ** 2 for a, b in zip(payload, payload[1:])) and int(said["crossings"]) == sum(a != b for a, b in zip(high, high[1:]))
        assert int(said["ms"]) == len(payload) * 1000 // 8000 and int(said["packets"]) == len(matroska.read_matroska(media)["packets"])


def test_hosts(spark):
    urls = ["https://User@WWW.Site.org:80/a?b", "//cdn.org/x", "nothing", None, "http://[::1]/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(html_text.host_of(df.u)).collect()][:4] == ["www.site.org", "cdn.org", "", ""]
