"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path; each is paired with whichever neighbour on
its host has the longer common path prefix (the earlier one on a tie). The text
lines of both are aligned by their longest common subsequence and shared lines
are deleted as boilerplate.

A copy of a page shares its article, so copies are no neighbours of each other:
pages that share over two thirds of the lines and of the characters of the one
with fewer. Between two pages next to each other that aren't copies is a break;
a page's neighbours are the pages at the nearest breaks before and after it that
aren't copies of it, of four breaks a side. Pages without text are passed over.

Differencing decides first, in every part of a page. Three things temper it:

* A page's own words are protected. In an article (else main) a shared line that is
  prose, i.e. stands in a paragraph, heading, list item or table row and isn't all
  link, stays: licence lines and passages that articles repeat are their text. What
  is shared there and is no prose (share bars, link lists, bare boxes) goes.
* Lines no neighbour shares are boilerplate where their element says so: by name
  (nav, footer, form, aside) or by a whole class, id or role ("ad", "cookie-notice",
  "related-posts", not "related-work" or "has-sidebar").
* A label never costs a page its article: where every article or main element is
  inside labelled elements or forms, these count as wrappers. Where there is neither
  and a label covers over half of the text, it counts as a wrapper, too.

n_shared counts the lines that differencing deletes, n_labelled those that only
their element's label does.

A null html is empty, a null url has host and path ''. Repeated rows give one
result each; a host's only page, or one with nothing but copies in reach, has no
neighbour and loses no line by differencing. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACE = frozenset("br td th".split())
#: Block elements that stand inside others' content models and end no open paragraph.
INNER = frozenset("body caption head html legend optgroup option tbody tfoot thead tr".split())
#: Elements beyond which an open paragraph isn't ended from inside.
SCOPE = frozenset("button canvas audio video object select table td th caption".split())
#: Elements that are never part of the main text.
DROP = frozenset("head nav footer aside form menu dialog button select object audio video canvas".split())
#: Words that say the same of any element where its class, id or role is made of them, of numbers and of FILLERS.
SAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login search social share sharing related recommended comment comments respond responses reply replies disqus widget toolbar pagination pager copyright complementary contentinfo".split()
)
FILLERS = frozenset("site page top bottom left right box bar block list item items section area wrapper wrap container inner outer panel slot unit buttons button links link form icons icon global primary secondary reader readers user users author body text meta posts articles stories news content col column row zone space thread threads".split())
#: Words that may stand before these.
OWNERS = frozenset("post entry article".split())
HEADER = frozenset("header topbar site-header page-header top-header site-topbar".split())
#: Elements whose text is prose unless all of it is a link.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr caption figcaption summary article main".split())
#: Breaks on each side of a page among which its neighbour is looked for.
REACH = 4


class _Open:
    """An open element: why it is boilerplate (numbers of reasons), its container (2 article, 1 main), the block it is in, whether it is in a link, and in an inline element that is never main text."""

    __slots__ = ("block", "link", "main", "name", "quiet", "whys")

    def __init__(self, name: str, whys: tuple[int, ...], main: int, block: str, link: bool, quiet: bool = False):
        self.name, self.whys, self.main, self.block, self.link, self.quiet = name, whys, main, block, link, quiet


@lru_cache(maxsize=4096)
def labelled(token: str) -> bool:
    """Whether a whole class, id or role says that its element is boilerplate."""
    words = _WORD.findall(token)
    if len(words) > 1 and words[0] in OWNERS:
        words = words[1:]
    return any(w in SAYS for w in words) and all(w in SAYS or w in FILLERS or w.isdigit() for w in words)


def _says(name: str, attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, is boilerplate by a label, and is marked as main."""
    if not attrs.strip():
        return False, False, False
    label = main = False
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), (a or b or c).lower()
        if k in ("class", "id", "role"):
            tokens = v.split()
            main |= k == "role" and "main" in tokens
            label |= any(labelled(t) or not inside and t in HEADER for t in tokens)
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", ""):
            return True, False, False
    return False, label and name not in ("html", "body", "main") and not main, main


OUTSIDE, LOOSE, PROTECTED, BOILERPLATE = 0, 1, 2, 9


def lines(page: str) -> tuple[list[str], bytes]:
    """The blocks of a page, and for each OUTSIDE, LOOSE (in the article, else main, but no prose), PROTECTED (prose there) or BOILERPLATE."""
    out: list[str] = []
    found: list[tuple[tuple[int, ...], int, bool]] = []  # of each block: reasons, container, prose
    reasons: list[str] = []  # "firm" or "label"
    wraps: set[int] = set()  # labels around an article or main
    held: list[tuple[str, _Open]] = []  # text, and the element it was said in
    root = _Open("", (), 0, "", False)
    stack: list[_Open] = []

    def flush() -> None:
        """Ends a block, but for those inside an inline element that is never main text. Text of elements in it that are boilerplate is a line of its own, so the block keeps what stands around them."""
        if stack and stack[-1].quiet:
            return say(" ")
        groups: dict[tuple[int, ...], list[tuple[str, _Open]]] = {}
        for text, element in held:
            groups.setdefault(element.whys, []).append((text, element))
        held.clear()
        for whys, pieces in groups.items():
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                first = next(x for t, x in pieces if t.strip())
                linked = sum(len("".join(t.split())) for t, x in pieces if x.link)
                out.append(text)
                found.append((whys, first.main, first.block in PROSE and linked < len(text.replace(" ", ""))))

    def say(text: str) -> None:
        held.append((text, stack[-1] if stack else root))

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            say(entities.unescape(page[at:]))
            break
        if m.start() > at:
            say(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end, attrs = (m["end"], m["attrs"]) if m["name"] else (m["end2"], m["attrs2"])
        if end:
            if name in BLOCK:
                flush()
            if name in SPACE:
                say(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    if name not in BLOCK and name not in DROP and any(x.name in BLOCK and x.name != "p" for x in stack[i + 1 :]):
                        break  # a stray inline end doesn't close blocks
                    del stack[i:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not attrs.rstrip().endswith("/"):
                tail = page.find(">", close.end()) if close else -1
                at = tail + 1 if tail >= 0 else n
            continue
        if name in BLOCK:
            flush()
            if name not in INNER:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        del stack[i:]  # a block ends an open paragraph with what is open in it
                        break
                    if stack[i].name in BLOCK or stack[i].name in SCOPE:
                        break
            if name in ("li", "dt", "dd", "tr", "option") and stack and stack[-1].name == name:
                stack.pop()
        elif name in SPACE or name in DROP:
            say(" ")
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        above = stack[-1] if stack else root
        hidden, label, main = _says(name, attrs, bool(above.main))
        whys = above.whys
        if hidden or name in DROP and name != "form" or name == "header" and not above.main:
            reasons.append("firm")
            whys = (*whys, len(reasons) - 1)
        elif label or name == "form":
            reasons.append("label")
            whys = (*whys, len(reasons) - 1)
        container = 2 if name == "article" or above.main == 2 else 1 if name == "main" or main or above.main else 0
        if container > above.main:
            wraps.update(w for w in whys if reasons[w] == "label")
        stack.append(_Open(name, whys, container, name if name in BLOCK else above.block, above.link or name in ("a", "button", "label"), above.quiet or name not in BLOCK and (hidden or name in DROP)))
    flush()

    freed: set[int] = set()
    if wraps and not any(c and not w for w, c, _ in found):
        freed = wraps
    elif not any(c for _, c, _ in found):
        size = lambda keep: sum(len(t) for t, (w, *_) in zip(out, found, strict=True) if keep(w))
        soft = lambda w: all(reasons[x] == "label" for x in w)
        every = size(soft)
        freed = {x for x in {x for w, *_ in found for x in w if reasons[x] == "label"} if 2 * size(lambda w, x=x: x in w and soft(w)) > every}
    dropped = [any(x not in freed for x in w) for w, *_ in found]
    best = max((c for (_, c, _), d in zip(found, dropped, strict=True) if not d), default=0)
    return out, bytes(BOILERPLATE if d else OUTSIDE if not c else PROTECTED if p and c == best else LOOSE for (_, c, p), d in zip(found, dropped, strict=True))


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """For each line of a, whether it is in the longest common subsequence with b (bit-parallel)."""
    shared = [False] * len(a)
    if not a or not b:
        return shared
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    ones = (1 << len(b)) - 1
    v, rows = ones, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & ones
        rows.append(v)
    j = len(b)
    for i in range(len(a) - 1, -1, -1):
        # zeros of a row count the subsequence's length over a prefix of b
        before = rows[i - 1] if i else ones
        while j and rows[i] >> (j - 1) & 1:
            j -= 1  # b[j - 1] adds nothing
        if j and before >> (j - 1) & 1:
            low = (1 << (j - 1)) - 1
            if (~rows[i] & low).bit_count() == (~before & low).bit_count() and a[i] == b[j - 1]:
                shared[i] = True
                j -= 1
    return shared


def main_text(blocks: list[str], kinds: bytes, other: list[str] | None) -> tuple[str, int, int]:
    """The text, and how many lines went because they are shared and because of a label alone."""
    shared = common_lines(blocks, other) if other else [False] * len(blocks)
    gone = [s and k != PROTECTED for k, s in zip(kinds, shared, strict=True)]
    text = "\n\n".join(t for t, k, g in zip(blocks, kinds, gone, strict=True) if not g and k != BOILERPLATE)
    return text, sum(gone), sum(k == BOILERPLATE and not g for k, g in zip(kinds, gone, strict=True))


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def marks(blocks: list[str], kinds: bytes) -> frozenset[int]:
    """What stands for a page's lines, without those that say they are boilerplate: 48 bits of a hash and the length of each."""
    return frozenset(int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big", signed=True) << 16 | min(len(t), 65535) for t, k in zip(blocks, kinds, strict=True) if k != BOILERPLATE)


def copies(a: frozenset[int], b: frozenset[int]) -> bool:
    shared = a & b
    return 3 * len(shared) > 2 * min(len(a), len(b)) and 3 * sum(x & 65535 for x in shared) > 2 * min(sum(x & 65535 for x in a), sum(x & 65535 for x in b))


def _beside(ranges: list[dict]) -> list[tuple[list[tuple], list[tuple]]]:
    """For each range of pages the keys of those at the nearest breaks before and after it, from near to far.

    A range has its first and last page and the pages at its first and last breaks, each as (key, marks)."""
    found = []
    for i, own in enumerate(ranges):
        sides = []
        for step, edge, far, breaks in ((-1, "first", "last", "before"), (1, "last", "first", "after")):
            out, at, j = [], own[edge], i + step
            while 0 <= j < len(ranges) and len(out) < REACH and ranges[j][far][0][0] == at[0][0]:
                if not copies(at[1], ranges[j][far][1]):
                    out.append(ranges[j][far][0])
                out += [k for k, _ in ranges[j][breaks] if k[0] == at[0][0]]
                if ranges[j][edge][0][0] != at[0][0]:
                    break  # the host begins or ends there
                at, j = ranges[j][edge], j + step
            sides.append(out[:REACH])
        found.append((sides[0], sides[1]))
    return found


def _keys(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.withColumns({
        "host": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)),
        "path": F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1),
        "key_id": F.coalesce(F.col("page_id"), F.lit(-(2**63))),
    })


def _even_ids(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n parts that a hash partitioning by it sends to a partition of its own, where there is one."""
    found = spark.range(20 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("to")).agg(F.min("id").alias("id")).collect()
    ids = [r.id for r in found]
    return ids + [20 * n + i for i in range(n - len(ids))]


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_labelled) of every page."""
    common.small_batches(spark, 500)
    n = common.partitions(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    # ranges of (host, path, id): the first key of each
    @common.lean
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [min(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in batches if b.num_rows]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(min(keys), (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "path", "key_id"])

    light = _keys(pages.select("page_id", "url")).select("host", "path", "key_id")
    starts = sorted((r.host, r.path, r.key_id) for r in light.repartitionByRange(n, "host", "path", "key_id").mapInArrow(least, "host string, path string, key_id long").collect())
    number = _even_ids(spark, max(n, len(starts)))
    known = spark.sparkContext.broadcast((starts, number))

    # the pages at the edges of each range and at the breaks next to them, from marks of the lines alone
    @common.lean
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, number = known.value
        for b in batches:
            out: list[tuple] = []
            for page, *key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = marks(*lines(page or ""))
                if found:
                    out.append((number[max(0, bisect_right(starts, tuple(key)) - 1)], *key, sum(found) % 2**62, list(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "host", "path", "key_id", "sig", "marks"])

    edge = "struct<host: string, path: string, key_id: bigint, sig: bigint, marks: array<bigint>>"
    kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("key_id", pa.int64()), ("sig", pa.int64()), ("marks", pa.list_(pa.int64()))])

    @common.lean
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda xs: [dict(zip(("host", "path", "key_id", "sig", "marks"), (*k, list(m)), strict=True)) for k, m in xs]

        def batch() -> pa.RecordBatch:
            ends = [as_rows([first]), as_rows([last]), as_rows(before), as_rows(after)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x in ends], ["first", "last", "before", "after"])

        first = last = own = None
        before: deque = deque(maxlen=REACH)  # pages that end a run of copies
        after: list = []  # pages that begin one
        for b in batches:
            for part, *key, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first and part != own:
                    yield batch()
                    first = last = None
                    before.clear()
                    after.clear()
                own, here = part, (tuple(key), frozenset(found))
                first = first or here
                if last and last[0][0] == key[0] and not copies(last[1], here[1]):
                    before.appendleft(last)
                    if len(after) < REACH:
                        after.append(here)
                last = here
        if first:
            yield batch()

    marked = _keys(pages).select("html", "host", "path", "key_id").mapInArrow(mark, "part int, host string, path string, key_id long, sig long, marks array<long>")
    rows = marked.repartition(len(number), "part").sortWithinPartitions("part", "host", "path", "key_id", "sig").select("part", "host", "path", "key_id", "sig", "marks").mapInArrow(edges, ", ".join(f"{x} array<{edge}>" for x in ("first", "last", "before", "after"))).collect()
    as_pages = lambda xs: [((x.host, x.path, x.key_id, x.sig), frozenset(x.marks)) for x in xs]
    ranges = sorted(({"first": as_pages(r.first)[0], "last": as_pages(r.last)[0], "before": as_pages(r.before), "after": as_pages(r.after)} for r in rows), key=lambda r: r["first"][0])
    to: dict[tuple, list[tuple[int, int]]] = {}
    for own, (before, after) in zip(ranges, _beside(ranges), strict=True):
        part = number[max(0, bisect_right(starts, own["first"][0][:3]) - 1)]
        for keys, side in ((before, -1), (after, 1)):
            for far, key in enumerate(keys):
                to.setdefault(key, []).append((part, side * (far + 1)))
    sent = spark.sparkContext.broadcast((starts, number, to))
    names = ["part", "side", "host", "path", "key_id", "sig", "page_id", "url", "lines", "kinds", "marks"]

    # side: 0 for a range's own pages, -1, -2, ... for those at breaks before it and 1, 2, ... after it
    @common.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, number, to = sent.value
        kinds_ = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            out: list[tuple] = []
            for page_id, url, page, *key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks, kinds = lines(page or "")
                found = marks(blocks, kinds)
                row = (*key, sum(found) % 2**62, page_id, url, blocks, kinds, list(found))
                out.append((number[max(0, bisect_right(starts, tuple(key)) - 1)], 0, *row))
                out += [(part, side, *row) for part, side in to.get(row[:4], ())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds_, strict=True)], names)

    parts = _keys(pages).select("page_id", "url", "html", "host", "path", "key_id").mapInArrow(cut, "part int, side int, host string, path string, key_id long, sig long, page_id long, url string, lines array<string>, kinds binary, marks array<long>")
    ordered = parts.repartition(len(number), "part").sortWithinPartitions("part", F.signum("side"), "host", "path", "key_id", "sig", "url")

    @common.lean
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[tuple] = []

        def say(page: dict, after: dict | None) -> None:
            near = [x for x in (page["before"], after) if x]
            other = max(near, key=lambda x: _prefix(x["key"][1], page["key"][1]), default=None)
            text, *gone = main_text(page["lines"], page["kinds"], other and other["lines"])
            out.append((page["page_id"], page["url"], text, len(text), *gone))

        def ended(y: dict) -> None:
            """y stands after a break: what waits for it has its neighbour or has had its last break."""
            still = []
            for x in waiting:
                if not copies(x["marks"], y["marks"]):
                    say(x, y)
                else:
                    x["breaks"] += 1
                    if x["breaks"] < REACH:
                        still.append(x)
                    else:
                        say(x, None)
            waiting[:] = still

        def alone() -> None:
            for x in waiting:
                say(x, None)
            waiting.clear()

        waiting: list[dict] = []
        breaks: deque = deque(maxlen=REACH)  # the pages before the nearest breaks, the nearest first
        pool: dict[str, str] = {}  # lines of copies are held once
        last = beside = own = None
        for part, side, *key, page_id, url, blocks, kinds, found in rows():
            page = {"key": tuple(key), "page_id": page_id, "url": url, "lines": blocks, "kinds": kinds, "marks": frozenset(found), "before": None, "breaks": 0}
            if part != own:
                alone()
                breaks.clear()
                last, beside, own = None, None, part
            if side:
                if page["key"] == beside:
                    continue  # a repeated row
                beside = page["key"]
                if side < 0:
                    breaks.appendleft(page)
                elif waiting and waiting[0]["key"][0] == key[0]:
                    ended(page)
                continue
            if not found:
                say(page, None)
            else:
                if not last:
                    if breaks and breaks[0]["key"][0] != key[0]:
                        breaks.clear()
                elif last["key"][0] != key[0]:
                    alone()
                    breaks.clear()
                elif not copies(last["marks"], page["marks"]):
                    breaks.appendleft({k: last[k] for k in ("key", "lines", "marks")})
                    ended(page)
                if not waiting:
                    pool.clear()
                page["lines"] = [pool.setdefault(t, t) for t in blocks]
                page["before"] = next((x for x in breaks if not copies(x["marks"], page["marks"])), None)
                waiting.append(page)
                last = page
            if len(out) >= 500:
                yield batch(out)
                out.clear()
        alone()
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars", "n_shared", "n_labelled"])

    return ordered.select(*names).mapInArrow(differ, "page_id long, url string, text string, n_chars long, n_shared long, n_labelled long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, common.parquet(spark, sf_dir, "pages"))
