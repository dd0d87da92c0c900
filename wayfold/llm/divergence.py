"""Divergence of sources: how far the term shares of a language's sources lie apart, and which terms tell a source from its language.

Each task counts the terms of its documents in byte radix tries (radix.Trie), one
a language, whose leaves have a counter for every source and one for documents. Terms
of a batch are counted on arrays first; those of some batches go into the tries in
order, each once. A trie that grows large is written out and begun anew. Tries are cut at prefixes,
shuffled by ranges of prefixes and merged there; a prefix with too many leaves for
one task is first cut deeper, as often as need be, so a hot prefix falls apart. The merged
tries are traversed in order of UTF-8, and terms in enough documents kept. A second
traversal of these sums the differences of all pairs of sources in blocks of
BLOCK x BLOCK, and keeps the TOP terms of each source; as terms come in order, a
later one with an equal value never displaces an earlier one.

Terms are runs of a-z and anything beyond ASCII, A-Z lower-cased. Shares are whole
numbers of billionths, all arithmetic is on integers. Null text, lang or source is
the empty string. A language without kept terms has pairs of value 0 and no terms;
a source alone in its language has no pairs. Repeated rows are documents of their
own. Other columns are not read, so names may clash. An empty table gives an empty
result. The list of (lang, source) goes to the driver and to every task: the result
has a row for each pair of them, so it is far smaller than that.
"""

from __future__ import annotations

import gc
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, radix

LEAST_DOCS, TOP, SMOOTH, WHOLE = 30, 50, 5, 10**9
#: Counts of batches before they go into tries; leaves of a task's tries before they are written out; leaves below one prefix; first length of prefixes; leaves of neighbouring prefixes that one trie merges.
COUNTED, HELD, MOST_LEAVES, DEPTH, TOGETHER = 2_000_000, 180_000, 50_000, 3, 5_000
#: Bytes of texts whose terms are counted at once.
PART = 4 << 20
#: Sources on each side of a block of pairs; terms taken at once.
BLOCK, CHUNK = 512, 256
DOCS = 2**32 - 1  # the counter of documents; the others are numbers of sources

_LETTERS = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of texts without nulls, one after the other; the number in each text."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(_LETTERS) if ends[-1] > ends[0] else b""
    ends, chars = ends - ends[0], np.frombuffer(data, np.uint8)
    letter = chars != 0x20
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begin = ends[:-1][ends[:-1] < len(chars)]
    first[begin] = letter[begin]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | first[1:]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(np.flatnonzero(last) - starts + 1, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars[letter])]), np.diff(np.searchsorted(starts, ends))


def count_terms(texts: pa.Array, counters: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of texts without nulls, one counter a text; then rows of (place of the term, counter, count), of which those of DOCS count the texts."""
    order = np.argsort(counters, kind="stable")
    counters = counters[order]
    words, sizes = _words(texts.take(pa.array(order)))
    coded = words.dictionary_encode()
    del words
    keys = coded.indices.to_numpy().astype(np.int64)
    keys *= len(counters)
    keys += np.repeat(np.arange(len(counters), dtype=np.int32), sizes)
    keys.sort()
    new = radix.changes(keys)  # a term in one text
    n, (term, text) = np.diff(np.append(new, len(keys))), np.divmod(keys[new], max(len(counters), 1))
    docs = np.bincount(term, minlength=len(coded.dictionary))
    at = radix.changes(term << 32 | counters[text])
    place = np.concatenate([term[at], np.arange(len(docs))])
    return coded.dictionary, place, np.concatenate([counters[text[at]], np.full(len(docs), DOCS)]), np.concatenate([np.add.reduceat(n, at) if len(at) else n, docs])


def insert(trie: radix.Trie, counted: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Puts what count_terms gave into a trie: each term once, in order."""
    base = np.cumsum([0, *(len(x[0]) for x in counted)])
    coded = pa.concat_arrays([x[0] for x in counted]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ranks = rank[coded.indices.to_numpy()]
    keys = np.concatenate([ranks[x[1] + base[i]] << 32 | x[2] for i, x in enumerate(counted)])
    keys, n = radix.summed(keys, np.concatenate([x[3] for x in counted]))
    trie.insert(coded.dictionary.take(order).to_numpy(zero_copy_only=False).tolist(), np.bincount(keys >> 32, minlength=len(order)), keys & DOCS, n)


def acyclic(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Tries have no cycles; without a search for cycles among their many nodes a task takes less time. References free them."""

    def wrapped(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return wrapped


PIECE = "lang string, prefix binary, leaves long, data binary"


def _piece_rows(lang: str, leaves: radix.Leaves, depth: int) -> Iterator[tuple]:
    for prefix, held in radix.pieces(leaves, depth):
        yield lang, prefix, len(held.terms), radix.pack(held)


def _piece_batches(rows: Iterator[tuple], size: int = 4000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _piece_batch(held)
            held = []
    if held:
        yield _piece_batch(held)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, prefix, leaves, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(prefix, pa.binary()), pa.array(leaves, pa.int64()), pa.array(data, pa.binary())], ["lang", "prefix", "leaves", "data"])


def count_tries(docs: DataFrame, ids: dict[tuple[str, str], int]) -> DataFrame:
    """The tasks' tries, cut at prefixes of DEPTH bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, list] = defaultdict(list)
        tries: dict[str, radix.Trie] = defaultdict(radix.Trie)
        held = 0

        def settle() -> None:
            for lang in list(counted):
                insert(tries[lang], counted.pop(lang))

        def write() -> Iterator[pa.RecordBatch]:
            yield from _piece_batches(row for lang, trie in tries.items() for row in _piece_rows(lang, trie.traverse(), DEPTH))
            tries.clear()

        for b in batches:
            texts, langs, sources = b.column(0).fill_null(""), b.column(1).to_pylist(), b.column(2).to_pylist()
            parts = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // PART
            rows: dict[tuple[str, int], list[int]] = defaultdict(list)
            for i, x in enumerate(zip(langs, parts.tolist(), strict=True)):
                rows[x].append(i)
            for (lang, _), mine in rows.items():
                counted[lang].append(count_terms(texts.take(pa.array(mine)), np.array([ids[lang, sources[i]] for i in mine])))
                held += len(counted[lang][-1][1])
            if held > COUNTED:
                settle()
                held = 0
                if sum(t.leaves for t in tries.values()) > HELD:
                    yield from write()
        settle()
        yield from write()

    empty = F.lit("")
    rows = docs.select(F.col("text").cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source")))
    return rows.mapInArrow(common.lean(acyclic(run)), PIECE)


def cut_deeper(pieces: DataFrame, folder: str, most: int) -> DataFrame:
    """Prefixes whose tries hold more leaves than one task should merge are cut at twice the depth, until none is left. The others stay as they are and aren't looked at again.

    A prefix that is one whole term can't be cut; its pieces hold one leaf each."""
    whole, depth, i = [], DEPTH, 0
    while True:
        large = pieces.groupBy("lang", "prefix").agg(F.sum("leaves").alias("n"), F.max("leaves").alias("most")).where((F.col("n") > most) & (F.col("most") > 1)).select("lang", "prefix")
        large = common.stage(large, folder, f"large-{i}")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, whole, pieces)
        depth, i = 2 * depth, i + 1

        def run(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _piece_batches(row for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for row in _piece_rows(lang, radix.unpack(data), depth))

        whole.append(common.stage(pieces.join(large, ["lang", "prefix"], "left_anti"), folder, f"whole-{i}"))
        pieces = common.stage(pieces.join(large, ["lang", "prefix"], "left_semi").select("lang", "data").mapInArrow(run, PIECE), folder, f"pieces-{i}")


KEPT = "lang string, term binary, source array<int>, n array<long>"


def kept_terms(pieces: DataFrame, least: int) -> DataFrame:
    """Terms in at least so many documents of their language, with their counts by source: tries merged by ranges of prefixes, traversed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie = None, radix.Trie()

        def traverse() -> Iterator[pa.RecordBatch]:
            terms, _, sizes, source, n = trie.traverse()
            leaf, whole = np.repeat(np.arange(len(terms)), sizes), source == DOCS
            docs = np.bincount(leaf[whole], n[whole], len(terms))
            kept = docs >= least
            if kept.any():
                rows = kept[leaf] & ~whole
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(leaf[rows], minlength=len(terms))[kept])]).astype(np.int32))
                term = [t for t, k in zip(terms, kept.tolist(), strict=True) if k]
                lists = (pa.ListArray.from_arrays(ends, pa.array(x[rows], t)) for x, t in ((source.astype(np.int32), pa.int32()), (n, pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(term), pa.string()), pa.array(term, pa.binary()), *lists], ["lang", "term", "source", "n"])

        for b in batches:
            for lang, prefix, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key and (lang != key[0] or (prefix != key[1] and trie.leaves >= TOGETHER)):
                    yield from traverse()
                    trie = radix.Trie()
                key = (lang, prefix)
                trie.merge(data)
        yield from traverse()

    dealt = pieces.select("lang", "prefix", "data").repartitionByRange(common.partitions(pieces.sparkSession), "lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(common.lean(acyclic(run)), KEPT)


def shares(counts: np.ndarray, total: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 v)), by long division in steps that stay whole."""
    below = np.asarray(total + SMOOTH * v)
    if int(below.max(initial=0)) >= 2**63 // 1000:
        below, counts = below.astype(object), counts.astype(object)
    rest, out = counts + SMOOTH, np.zeros_like(counts)
    whole, rest = rest // below, rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return (1 + whole * WHOLE + out).astype(np.int64)


SCORED = "lang string, source int, part string, other int, term binary, value long"


def score(kept: DataFrame, groups: dict[str, list[int]], totals: dict[int, int], v: dict[str, int], top: int, block: int = BLOCK) -> DataFrame:
    """Partial sums of the pairs, and each task's best terms of every source."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        sums = np.zeros((0, 0), dtype=np.int64)
        best: dict[int, list] = {}
        order = 0

        def begin() -> None:
            nonlocal sums, best
            lang, a, b = key
            rows, columns = (groups[lang][x * block : (x + 1) * block] for x in (a, b))
            sums, best = np.zeros((len(rows), len(columns)), dtype=np.int64), {s: [] for s in rows}

        def take() -> None:
            nonlocal order
            lang, a, b = key
            every = groups[lang]
            place = {s: i for i, s in enumerate(every)}
            counts = np.zeros((len(held), len(every)), dtype=np.int64)
            for i, (_, source, n) in enumerate(held):
                counts[i, [place[s] for s in source]] = n
            total = np.array([totals.get(s, 0) for s in every], dtype=np.int64)
            mine = slice(a * block, (a + 1) * block)
            p = shares(counts[:, mine], total[mine], v[lang])
            q = p if a == b else shares(counts[:, b * block : (b + 1) * block], total[b * block : (b + 1) * block], v[lang])
            for i in range(p.shape[1]):
                sums[i] += np.abs(p[:, i : i + 1] - q).sum(axis=0)
            if b == 0:  # terms once for each block of sources
                over = p - shares(counts.sum(axis=1), int(total.sum()), v[lang])[:, None]
                for i, s in enumerate(every[mine]):
                    heap = best[s]
                    for k in np.flatnonzero((over[:, i] > 0) & (counts[:, mine][:, i] > 0)):
                        value = int(over[k, i])
                        if len(heap) < top:
                            heapq.heappush(heap, (value, -order - int(k), held[k][0]))
                        elif value > heap[0][0]:
                            heapq.heapreplace(heap, (value, -order - int(k), held[k][0]))
            order += len(held)
            held.clear()

        def end() -> Iterator[pa.RecordBatch]:
            lang, a, b = key
            rows, columns = (groups[lang][x * block : (x + 1) * block] for x in (a, b))
            out = [(lang, s, "pair", t, None, int(sums[i, j])) for i, s in enumerate(rows) for j, t in enumerate(columns) if s != t]
            out += [(lang, s, "term", None, term, value) for s, heap in best.items() for value, _, term in heap]
            for at in range(0, len(out), 10_000):
                columns_ = list(zip(*out[at : at + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["lang", "source", "part", "other", "term", "value"])

        for b in batches:
            for lang, x, y, term, source, n in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (lang, x, y) != key:
                    if key:
                        take()
                        yield from end()
                    key = (lang, x, y)
                    begin()
                held.append((term, source, n))
                if len(held) == CHUNK:
                    take()
        if key:
            take()
            yield from end()

    blocks = max((-(-len(g) // block) for g in groups.values()), default=1)
    table = kept.sparkSession.createDataFrame([(lang, -(-len(g) // block)) for lang, g in groups.items()], "lang string, blocks int") if blocks > 1 else None
    wide = kept.withColumn("blocks", F.lit(1)) if table is None else kept.join(F.broadcast(table), "lang")
    each = wide.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("lang", "a", "b", "term", "source", "n").sortWithinPartitions("lang", "a", "b", "term").mapInArrow(run, SCORED)


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, most_leaves: int = MOST_LEAVES, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source its distance from every other of its language, and its telling terms."""
    common.small_batches(spark)
    folder = common.work_folder(spark, "divergence")
    empty = F.lit("")
    pairs = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source"))).distinct()
    named = sorted((r.lang, r.source) for r in pairs.collect())
    ids = {x: i for i, x in enumerate(named)}
    groups: dict[str, list[int]] = defaultdict(list)
    for (lang, _), i in ids.items():
        groups[lang].append(i)
    groups = dict(groups)

    pieces = common.stage(count_tries(docs, ids), folder, "pieces")
    kept = common.stage(kept_terms(cut_deeper(pieces, folder, most_leaves), least), folder, "kept")
    flat = kept.select(F.explode(F.arrays_zip("source", "n")).alias("x"))
    totals = {r.source: r.n for r in flat.groupBy("x.source").agg(F.sum("x.n").alias("n")).collect()}
    v = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    scored = score(kept, groups, totals, v, top, block)

    names = spark.createDataFrame([(i, lang, source) for (lang, source), i in ids.items()], "id int, lang string, source string")
    one, two = names.withColumnsRenamed({"id": "a"}), names.select("lang", F.col("id").alias("b"), F.col("source").alias("item"))
    zero = one.join(two, "lang").where("a <> b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    scored = common.stage(scored, folder, "scored")
    summed = scored.where("part = 'pair'").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), "value").unionByName(zero).groupBy("a", "b").agg(F.sum("value").alias("value"))
    label = lambda rows, key, name: rows.join(names.select(F.col("id").alias(key), F.col("source").alias(name), *([F.col("lang")] if name == "source" else [])), key)
    far = label(label(summed, "a", "source"), "b", "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    told = label(scored.where("part = 'term'").select(F.col("source").alias("a"), "term", "value"), "a", "source").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranks = lambda rows: rows.withColumn("rank", F.row_number().over(w))
    return ranks(far).unionByName(ranks(told).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, common.parquet(spark, sf_dir, "documents"))


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
words AS (SELECT r, lang, source, unnest(ws) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v))::BIGINT AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 5)) // ((SELECT sum(total) FROM total t WHERE t.lang = p.lang) + 5 * (SELECT v FROM v WHERE v.lang = p.lang)))::BIGINT AS q FROM p GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
