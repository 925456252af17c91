import hashlib
import struct
import zlib

import numpy as np
import pytest

from terraloom.llm import html_main, media


def test_round_trip_and_digests(make_docs, odd):
    rows = [(1, "x"), (2, ""), (3, None), (4, "é" * 1000), (5, "a" * 576), (6, "abc " * 5000)]
    for r in media.media_features(make_docs(rows)).collect():
        data = (dict(rows)[r.doc_id] or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert media.media_features(odd).count() == 8 and media.media_features(odd.limit(0)).count() == 0


def test_frames_decode_alone_and_without_index():
    x = np.random.default_rng(2).integers(0, 256, (7, 24, 24)).astype(np.uint8)
    x[2], x[3] = 0, 255
    avi = media.write_avi(x, rate=10)
    rate, images = media.read_avi(avi)
    assert rate == 10 and media.read_avi(avi.replace(b"idx1", b"JUNK"))[1] == images
    for image, frame, fast in zip(images, x, media.decode_frames(images), strict=True):
        assert (media.decode_jpeg(image) == frame).all() and (fast == frame).all()


def baseline(gray):
    """A baseline image of flat 8x8 blocks with one quantiser of 8, so the DC value is exact."""
    h, w = gray.shape
    bits, last = "", 0
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            dc = int(gray[y, x]) - 128
            d, last = dc - last, dc
            s = abs(d).bit_length()
            bits += format(s, "04b") + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "") + "0"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    dc = bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])
    ac = bytes([0x10, 1, *[0] * 15, 0])
    return b"\xff\xd8" + seg(0xDB, bytes([0, *[8] * 64])) + seg(0xC0, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0])) + seg(0xC4, dc + ac) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_baseline_frames():
    gray = np.kron(np.random.default_rng(1).integers(0, 256, (3, 4)), np.ones((8, 8), int)).astype(np.uint8)
    assert (media.decode_jpeg(baseline(gray)) == gray).all()


def test_clips(spark):
    dark, light = np.full((10, 24, 24), 20, np.uint8), np.full((6, 24, 24), 230, np.uint8)
    avi = media.write_avi(np.concatenate([dark, light]), rate=2)
    rows = spark.createDataFrame([(1, bytearray(avi)), (2, None), (3, bytearray(b"RIFFxxxx")), (4, bytearray(avi[:300]))], "doc_id long, media binary")
    out = {(r.id, r.clip): r for r in media.clips(rows).collect()}
    assert (out[1, 0].start_s, out[1, 0].end_s, out[1, 1].start_s, out[1, 1].end_s) == (0.0, 5.0, 5.0, 8.0)
    assert out[1, 1].brightness == 230 and all(out[i, None].error for i in (2, 3, 4))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><div class=menu>x</div><p>a&lt;b<br>c <i>d</i>e</p><div id='comments'><p>no</p></div><form>f</form>tail<!-- x -->", "a<b c de tail"),
        ("<nav>n</nav><article><h1>T</h1><p>one  <b>two</b>\n<p>three<script>x='</p>'</script><aside>s</aside></article><footer>f</footer>", "T one two three"),
        ("<form><article>in form</article>no</form>", "in form"),
        ("<article>cut off <p>here", "cut off here"),
        ('<main><p title="a>b">x</p><section class="comments"><article class="comment">c</article></section></main>', "x"),
        ("<header><h1>site</h1></header><article><header><h1>Title</h1></header>body</article>", "Title body"),
        ("<p>a</p><style>p{}</style><noscript>js</noscript><div hidden>h</div><div role=navigation>n</div><p>b</p>", "a b"),
    ],
)
def test_main_text_of_a_page(page, text):
    assert html_main.extract(page, set()) == text


def test_style_tree_drops_what_pages_repeat(spark):
    pages = [(i, f"https://Site.example/p{i}", f"<body><div class=top>Site name and claims</div><div class=body><p>Text of page {i}, {'word ' * i}</p></div><div class=low>All rights kept</div></body>") for i in range(12)]
    pages += [(100 + i, f"http://other{i}.example", "<body><div class=top>Site name and claims</div></body>") for i in range(3)]
    pages += [(200, None, "<p>x</p>"), (201, "not a url", None), (0, "https://site.example/p0", "<article>own</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = html_main.main_texts(df).collect()
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) for r in out)
    for r in out:
        if r.page_id < 12 and r.text != "own":
            assert r.text.startswith("Text of page") and "rights" not in r.text and "Site" not in r.text
        elif r.page_id in (100, 101, 102):
            assert r.text == "Site name and claims"
    assert html_main.main_texts(df.limit(0)).count() == 0


def test_host():
    assert [html_main.host(u) for u in ("HTTP://u:p@A.b:80/x", "//c.d?q", "nope", None)] == ["a.b", "c.d", None, None]


def test_main_elements_are_a_prior_only(spark):
    card = "<article class=card>See our other pages</article>"
    pages = [(i, f"https://cards.example/{i}", f"<body><div class=text><p>Long text of page {i}, {'word ' * i}</p></div>{card}</body>") for i in range(12)]
    body = lambda i: f"<article>By us<h1>Title {i}</h1><p>Body of page {i}</p><p>Subscribe to our letter</p><div class=rights>Licensed text</div></article>"
    pages += [(100 + i, f"https://letters.example/{i}", f"<body><div class=top>Site claims</div>{body(i)}</body>") for i in range(12)]
    out = {r.page_id: r.text for r in html_main.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert out[i] == " ".join(f"Long text of page {i}, {'word ' * i}".split())
        assert out[100 + i] == f"Title {i} Body of page {i}"


@pytest.mark.parametrize("names", ["single no-sidebar", "has-sidebar", "admin-nav menu", "menu"])
def test_names_of_wrappers_empty_no_page(names):
    inner = "<article><p>The text of it, long enough</p></article><div class='sidebar'>side</div><div class='site-footer'>foot</div>"
    for page in (f"<body class='{names}'>{inner}</body>", f"<html class='{names}'><body>{inner}</body></html>", f"<body><div class='{names}'>{inner}</div></body>"):
        assert html_main.extract(page, set()) == "The text of it, long enough"
    states = "<div class=no-sidebar>short</div><div class=menu>cut</div><p>The text of it, long enough</p>"
    assert html_main.extract(states, set()) == "short The text of it, long enough"


def test_copies_of_a_page_are_no_evidence(spark):
    page = lambda i: f"<body><div class=text><p>Text of article {i}, {'word ' * i}</p></div><div class=low>All rights kept</div></body>"
    pages = [(i, f"https://copies.example/{i}", page(max(0, i - 99))) for i in range(120)]
    out = {r.page_id: r.text for r in html_main.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Text of article {(n := max(0, i - 99))}, {'word ' * n}".strip() for i in range(120)}


LONG = "reader says a lot here " * 60


@pytest.mark.parametrize("name", ["comments", "comment-section", "site-footer", "newsletter-box", "reader-comments", "ad-slot", "feedback", "cookieNotice", "side-bar", "related_posts", "share-buttons", "post-comments", "advert2"])
def test_noise_goes_however_long(name):
    short = f"<div class='{name}'><p>no</p></div>"
    for noise in (short, short.replace("no", LONG), f"<section id='{name}'><article>{LONG}</article></section>"):
        assert html_main.extract(f"<body><article><h1>T</h1><p>Main text</p></article>{noise}</body>", set()) == "T Main text"
        assert html_main.extract(f"<body><div class=story><p>Main text</p></div>{noise.replace('article', 'div')}</body>", set()) == "Main text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><form id=aspnetForm><div><h1>T</h1><p>Body of the page</p></div></form></body>", "T Body of the page"),
        ("<body><p>Text</p><form><p>Your name</p></form></body>", "Text"),
        ("<body><form action=/s><label>Search</label></form></body>", ""),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "so x=2 holds"),
        ("<article><div class=article-header>By us</div><div class=entry-content><p>x</p></div><div class=no-comments>y</div></article>", "By us x y"),
        ("<p title='a > b' data-x=\"<p>\">x < y <b a=1>z</b></p>", "x < y z"),
        ("<p>a</x></p></p>b<svg><p>c", "a b c"),
    ],
)
def test_forms_marks_and_names(page, text):
    assert html_main.extract(page, set()) == text


def test_time_and_memory_are_linear():
    import time
    import tracemalloc

    pages = ["<a b " * 200_000, "<a '" * 250_000, "<a b=\"" * 150_000, "<!--" * 250_000, "<svg>" * 200_000, "</x>" * 200_000 + "<p>end", "<div>" * 50_000 + "x" + "</b></q></div>" * 50_000, "<p>" + "<" * 500_000, "= " * 500_000, "<a = " * 200_000, "&" * 500_000, "<div class='a b c'>" * 50_000 + "deep"]
    for page in pages:
        began = time.time()
        html_main.tree_rows(page)
        html_main.extract(page, set())
        assert time.time() - began < 6, page[:20]
    tracemalloc.start()
    html_main.tree_rows("<div class=some-name>" * 50_000 + "x")
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_numbers_in_names_do_not_part_elements():
    one, two = (html_main.tree_rows(f"<div id='post-{n}' class='x{n} c-{h}'><p>text {n}</p></div>") for n, h in ((1, "12ab34cd"), (77, "99ff00aa")))
    assert [r[1] for r in one if r[3]] == [r[1] for r in two if r[3]]
