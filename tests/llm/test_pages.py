import os
import random
import re

import pytest

from wayfold.llm import html_text, warc

SCHEMA = "page_id long, url string, html string, text string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute_warc(rows, least=0):
    out = []
    top = {}
    for i, _, h in rows:
        top.setdefault(h or "", []).append(i)
    for i, _, h in rows:
        data = (h or "").encode()
        m = max(top[h or ""], key=lambda x: -(2**63) if x is None else x)
        first = len(data) < least or i == m
        out.append((i, len(data), warc.base32_sha1(data), "response" if first else "revisit", None if first else m))
    return sorted(out, key=str)


def test_warc_round_trip_and_determinism(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/p{i}\n" if i % 5 else None, f"<p>é page {i % 11}</p>" * (i % 7)) for i in range(80)] + [(200, "u", None), (201, "u", ""), (202, "big", "x" * 400_000), (None, "none", "<p>é page 1</p>")]
    random.Random(1).shuffle(rows)
    for least in (0, 30):
        kept = []
        for run in range(2):
            folder = f"file://{tmp_path}/{least}-{run}"
            manifest = warc.write(spark, pages(spark, rows if run else rows[::-1]).coalesce(1), folder, least, file_bytes=1500)
            got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder, manifest).collect()), key=str)
            assert got == brute_warc(rows, least)
            kept.append(sorted((m.records, m.bytes, m.sha256) for m in manifest.collect()))
        assert len(kept[0]) > 4
        assert sum(m[0] for m in kept[0]) == len(rows)


def test_warc_repeats_of_one_row(spark, tmp_path):
    manifest = warc.write(spark, pages(spark, [(1, "u", "same")] * 3 + [(2, "u", None)]), f"file://{tmp_path}/a")
    got = warc.read(spark, f"file://{tmp_path}/a", manifest).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id == 1) == sorted([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1)], key=str)
    none = warc.write(spark, pages(spark, []), f"file://{tmp_path}/b")
    assert warc.read(spark, f"file://{tmp_path}/b", none).collect() == []


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(400):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        mask = html_text.common_lines(a, b)
        shared = [x for x, m in zip(a, mask, strict=True) if m]
        assert len(shared) == lcs_length(a, b)
        rest = iter(b)
        assert all(x in rest for x in shared)


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><aside>Side</aside>
<article><h1>Title &amp; more</h1><p><b>One &eacute;<br>two<p>Three   four
five<ul><li>i<li>j</ul><div class="cookie-notice">Cookies</div><form><input><label>Mail</label></form>
<section id="comments"><p>First!</p></section><table><tr><td>a<td>b</table>2 &lt; 3 < 4</article><footer>&copy; x</body>"""


def test_structure():
    blocks, kinds = html_text.lines(ARTICLE)
    assert html_text.main_text(blocks, kinds, None)[0] == "Title & more\n\nOne é two\n\nThree four five\n\ni\n\nj\n\na b\n\n2 < 3 < 4"
    for odd in ("", "plain", "<", "<p", "<p a='", "<!--", "<script>x", "</p></div>", "a" * 200_000, "<div>" * 3000 + "x", '<a title="' * 2000):
        html_text.lines(odd)


def test_differencing_decides_without_a_container(spark):
    page = lambda i: f"<body><p>Welcome to the site</p><p>Story {i}</p><p>More {i}</p><p>All rights</p></body>"
    rows = [(i, f"https://Host.example/a/{i:03d}?q={i}", page(i)) for i in range(40)] + [(100, "http://other/", page(7)), (101, None, page(8)), (102, "x", None), (103, "http://host.example/a/003", ARTICLE), (5, "https://host.example/a/005", page(5)), (None, "https://nobody/", page(9))]
    got = {}
    for r in html_text.extract(spark, pages(spark, rows)).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    for i in range(40):
        if i not in (3, 4, 5, 2):
            assert got[i] == [f"Story {i}\n\nMore {i}"], i
    assert got[100] == ["Welcome to the site\n\nStory 7\n\nMore 7\n\nAll rights"]  # a host's only page
    assert got[102] == [""] and got[103][0].startswith("Title & more")
    assert html_text.extract(spark, pages(spark, [])).collect() == []


def test_differencing_decides_outside_a_container(spark):
    page = lambda i: f"<body><p>Welcome</p><p>Standfirst {i}</p><article><p>Story {i}</p><p>Told often</p></article><p>All rights</p><nav>Menu {i}</nav></body>"
    rows = [(i, f"https://host.example/a/{i:03d}", page(i)) for i in range(20)] + [(100, "https://other.example/", page(100))]
    got = {r.page_id: r.text for r in html_text.extract(spark, pages(spark, rows)).collect()}
    assert got.pop(100) == "Welcome\n\nStandfirst 100\n\nStory 100\n\nTold often\n\nAll rights"  # no neighbour
    assert got == {i: f"Standfirst {i}\n\nStory {i}\n\nTold often" for i in range(20)}


def test_copies_are_no_neighbours(spark):
    page = lambda i, more="": f"<body><p>Welcome to the site</p><p>Story {i}</p><p>And so on {i}, at length.</p><p>More {i}</p><p>It ends {i}.</p>{more}<p>All rights</p></body>"
    told = lambda i: f"Story {i}\n\nAnd so on {i}, at length.\n\nMore {i}\n\nIt ends {i}."
    rows = [(i, f"https://host.example/a/{i:03d}", page(i)) for i in range(0, 40, 2)]
    rows += [(100 + i, f"https://host.example/a/010?q={i}", page(10)) for i in range(30)]  # exact copies, also of one path
    rows += [(200 + i, f"https://host.example/a/020/{i}", page(20, f"<p>Read {i} times</p>")) for i in range(30)]  # near copies
    rows += [(300 + i, f"https://host.example/a/021/{i}", "<p></p>") for i in range(3)] + [(400 + i, f"https://copies.example/{i}", page(1)) for i in range(9)]
    want = {i: told(i) for i in range(0, 40, 2)} | {100 + i: told(10) for i in range(30)} | {200 + i: told(20) + f"\n\nRead {i} times" for i in range(30)}
    want |= {300 + i: "" for i in range(3)} | {400 + i: f"Welcome to the site\n\n{told(1)}\n\nAll rights" for i in range(9)}
    for parts in (1, 4, 25):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r.page_id: r.text for r in html_text.extract(spark, pages(spark, rows)).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_neighbours_whatever_the_ranges(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        own = [f"own {rng.randrange(6)} {k}" for k in range(4)]
        kept = [x for x in ("top", *own, "bottom", f"p {i}") if rng.random() < 0.85] if i % 9 else []
        rows.append((i, f"https://h{i // 70}.example/{i:04d}"[: rng.choice((24, 25, 26))], "".join(f"<p>{x}</p>" for x in kept)))
    cut = [(i, u, u.split("/")[2], "/" + u.split("/", 3)[3] if u.count("/") > 2 else "", html_text.lines(h)) for i, u, h in rows]
    cut = [(i, h, p, b, k, html_text.marks(b, k)) for i, _, h, p, (b, k) in cut]
    order = sorted((x for x in cut if x[5]), key=lambda x: (x[1], x[2], x[0]))
    want = {x[0]: "" for x in cut}
    for at, x in enumerate(order):
        near = []
        for step in (-1, 1):
            j, breaks = at, 0
            while 0 <= j + step < len(order) and order[j + step][1] == x[1] and breaks < html_text.REACH:
                j += step
                if not html_text.copies(order[j][5], order[j - step][5]):
                    breaks += 1
                    if not html_text.copies(order[j][5], x[5]):
                        near.append(order[j])
                        break
        other = max(near, key=lambda y: html_text._prefix(y[2], x[2]), default=None)
        want[x[0]] = html_text.main_text(x[3], x[4], other and other[3])[0]
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r.page_id: r.text for r in html_text.extract(spark, pages(spark, rows)).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


LABELS = [
    ('<article class="post has-sidebar"><p>Text</p></article>', "Text"),
    ('<article class="post no-comments"><p>Text</p></article>', "Text"),
    ('<article class="related-post"><p>Text</p></article>', "Text"),
    ('<article class="social-science"><p>Text</p></article>', "Text"),
    ('<article class="search-result"><p>Text</p></article>', "Text"),
    ('<article id="post-login-guide"><p>Text</p></article>', "Text"),
    ('<form action="/"><input><article><p>Text</p></article><label>Mail</label></form>', "Text\n\nMail"),
    ('<article><div class="post-header"><h1>Title</h1></div><p>Text</p></article>', "Title\n\nText"),
    ("<main><p>intro</p><article>teaser</article><p>rest</p></main>", "intro\n\nteaser\n\nrest"),
    ('<article class="comment"><p>Only one</p></article>', "Only one"),
    ('<article><p>Text</p></article><section id="comments"><article class="comment"><p>First!</p></article></section>', "Text"),
    ('<article><p>Text</p></article><div class="related-posts"><article>Card</article></div>', "Text"),
    ('<div class="sidebar"><p>The whole of it, long enough.</p></div><p>Bit</p>', "The whole of it, long enough.\n\nBit"),
    ('<article><section id="related-work"><h2>Related work</h2><p>Let <math><mi>x</mi></math> be</p></section></article>', "Related work\n\nLet x be"),
    ('<article><p>Text</p><div class="cookie-notice">Cookies</div><div class="ad-slot">Buy</div></article>', "Text"),
]


@pytest.mark.parametrize(("page", "text"), LABELS)
def test_labels_are_one_signal_only(page, text):
    assert html_text.main_text(*html_text.lines(f"<body><nav>Menu</nav>{page}</body>"), None)[0] == text


def test_differencing_decides_inside_an_article(spark):
    page = lambda i: f"<body><article><div>Share this story</div><h1>Told often</h1><p>Story {i}</p><p>It was long {i}, and went on.</p><p>So it ended {i}, at last.</p><p>Licence of all</p><ul><li><a href='/n'>Next story</a></li><li>Point</li></ul></article></body>"
    rows = [(i, f"https://host.example/a/{i:03d}", page(i)) for i in range(12)]
    for r in html_text.extract(spark, pages(spark, rows)).collect():
        assert r.text == f"Told often\n\nStory {r.page_id}\n\nIt was long {r.page_id}, and went on.\n\nSo it ended {r.page_id}, at last.\n\nLicence of all\n\nPoint" and r.n_shared == 2


def brute_pages(rows):
    """Every page's text by plain loops: neighbours by walking over breaks, the subsequence by a table."""
    out, hosts = [], {}
    for i, url, h in rows:
        m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://([^/?#]*))?([^?#]*)", url or "")
        blocks, kinds = html_text.lines(h or "")
        hosts.setdefault((m[2] or "").lower(), []).append((m[3], i, url, blocks, kinds, {t for t, k in zip(blocks, kinds, strict=True) if k != html_text.BOILERPLATE}))

    def copies(a, b):
        both = a & b
        size = lambda x: sum(map(len, x))
        return 3 * len(both) > 2 * min(len(a), len(b)) and 3 * size(both) > 2 * min(size(a), size(b))

    def near(at, own, step):
        breaks, j = 0, at
        while 0 <= j + step < len(own) and breaks < html_text.REACH:
            if not copies(own[j][5], own[j + step][5]):
                breaks += 1
                if not copies(own[at][5], own[j + step][5]):
                    return own[j + step]
            j += step
        return None

    for every in hosts.values():
        every.sort(key=lambda x: x[:2])
        own = [x for x in every if x[5]]
        for x in every:
            _, i, url, blocks, kinds, marks = x
            sides = [near(own.index(x), own, s) for s in (-1, 1)] if marks else []
            other = max((y for y in sides if y), key=lambda y: len(os.path.commonprefix([x[0], y[0]])), default=None)
            shared = [False] * len(blocks)
            if other:
                b = other[3]
                t = [[0] * (len(b) + 1) for _ in range(len(blocks) + 1)]
                for p, line in enumerate(blocks):
                    for q, o in enumerate(b):
                        t[p + 1][q + 1] = t[p][q] + 1 if line == o else max(t[p][q + 1], t[p + 1][q])
                p, q = len(blocks), len(b)
                while p and q:
                    if t[p][q] == t[p][q - 1]:
                        q -= 1
                    elif t[p][q] == t[p - 1][q]:
                        p -= 1
                    else:
                        p, q = p - 1, q - 1
                        shared[p] = True
            out.append((i, url, "\n\n".join(t for t, k, s in zip(blocks, kinds, shared, strict=True) if k != 9 and not (s and k != 2)), sum(s and k != 2 for k, s in zip(kinds, shared, strict=True))))
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_equals_brute_force_on_whole_tables(spark, sf):
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("test tables aren't here")
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((r.page_id, r.url, r.text, r.n_shared) for r in html_text.op4_html_text(spark, f"/root/testdata/{sf}").collect())
    assert got == brute_pages(rows)
    assert sf == "sf0.001" or sum(n > 0 for *_, n in got) > 0  # pages that differencing deletes lines of
    print(sf, sum(n > 0 for *_, n in got), len(got))


INLINE = [
    ("<article><p>x <select><option>a</option></select> y</p></article>", "x y"),
    ("<p>Hello <button>Share</button> world</p>", "Hello world"),
    ("<p>Hello <span hidden>secret</span> world</p>", "Hello world"),
    ('<p>Hello <span style="display: none">secret</span>world</p>', "Hello world"),
    ('<p>Hello <span class="ad">Buy</span> world</p><p>and more of it, so that it is long</p>', "Hello world\n\nand more of it, so that it is long"),
    ("<article><p>See <video><source>No video here</video> this</p></article>", "See this"),
    ("<article><p>See <object>No plug-in</object>this <audio>none</audio>too</p></article>", "See this too"),
    ('<article><p>Text</p><div id="disqus_thread"><p>First!</p></div></article>', "Text"),
    ('<article><p>Text</p><section id="responses"><p>First!</p></section></article>', "Text"),
    ("<article><p>a <select><optgroup><option>b<option>c</select> d <b>e</b></p><p>f</article>", "a d e\n\nf"),
    ("<article><p>a <button><div>b</div></button> c</p></article>", "a c"),
    ("<article><table><tr><td><p>a<td>b</table><p>c <i>d<p>e</i> f</article>", "a b\n\nc d\n\ne f"),
    ("<article><p>in<b>si</b>de<span hidden>x</span>s</p></article>", "insides"),
]


@pytest.mark.parametrize(("page", "text"), INLINE)
def test_text_goes_with_the_element_it_stands_in(page, text):
    assert html_text.main_text(*html_text.lines(f"<body>{page}</body>"), None)[0] == text


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_word_of_a_page_is_lost(spark, sf):
    """The standard library's parser reads the same words in the same order, whatever is decided on them afterwards."""
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("test tables aren't here")
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.raw, self.text = None, []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.RAW and not self.raw:
                self.raw = tag
            elif tag in html_text.BLOCK or tag in html_text.SPACE:
                self.text.append(" ")

        def handle_endtag(self, tag):
            self.raw = None if tag == self.raw else self.raw
            if tag in html_text.BLOCK or tag in html_text.SPACE:
                self.text.append(" ")

        def handle_data(self, data):
            if not self.raw:
                self.text.append(data)

    for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html").collect():
        w = Words()
        w.feed(r.html or "")
        w.close()
        assert " ".join(html_text.lines(r.html or "")[0]).split() == "".join(w.text).split()
