"""Substring dedup: words covered by a window of ``width`` words that also starts in a document with a smaller doc_id.

Suffixes (what follows a word) are split by prefixes of variable length into groups
that fit a task, and a group's suffix tree is built from its sorted suffixes and
their longest common prefixes. Inner nodes of depth ``width`` or more are the
maximal repeats; below each, every leaf of a document after the first one starts a
window to remove.

The prefix of a suffix ends where the least GRAM-word hash within its first
``width`` words ends, so equal windows have equal prefixes, whatever their length,
and all suffixes with the same closing gram lie in one group. A gram is a few per
cent of all positions. Grams are counted first: one that stands in one text only
closes no prefix that repeats, and its suffixes are dropped without a loss. The
others' windows are sent to their group as words. A gram with over CONTEXTS places
has its prefixes lengthened: first to all the words of a place, then to the whole
window, both by a 128-bit hash. Places with equal words are one, the first document
stands for them, and windows are compared between different ones only, so a passage
that a third of all documents share is combined before it is shuffled.

Texts with equal words are one: all but the one with the smallest doc_id lose all
their words if they have ``width`` or more, and only that one takes part.

Words stand between the six ASCII white spaces. A null or empty text has no words.
A null doc_id is larger than any other; rows that repeat a doc_id remove nothing
from each other. Other columns are not read, so names may clash. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, GRAM = 50, 8
#: Places of a gram whose suffixes share one group (some 40 MB of symbols), and places after which a task builds its trees.
CONTEXTS, BATCH = 8000, 1500

_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_rng.integers(0, 2**63)) | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_UNDO = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []
_LAST = 2**63 - 1


def _upto(n: int) -> list[np.ndarray]:
    """Powers up to n of the base and of its inverse modulo 2^64; long ones are made again, not kept."""
    global _powers
    if _powers and n < len(_powers[0]):
        return _powers
    made = []
    for base in (_BASE, _UNDO):
        p = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        made.append(np.cumprod(p))
    if len(made[0]) <= 1 << 20:
        _powers = made
    return made


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grams_of(data: bytes, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` words, a function of these words alone."""
    a = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[a], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(start) - gram + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    power, undo = _upto(len(a))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[a] * power[: len(a)])])
    word = _mix((sums[end] - sums[start]) * undo[start])
    out = np.zeros(n, dtype=np.uint64)
    for i in range(gram):
        out = out * _BASE + word[i : i + n]
    return _mix(out)


def closing(grams: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its least gram, and that one's place (the first of equals)."""
    span = width - gram + 1
    n = len(grams) - span + 1
    if n < 1:
        return grams[:0], np.zeros(0, dtype=np.int64)
    least, at, held = grams, np.arange(len(grams)), 1

    def join(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = x <= y
        return np.where(left, x, y), np.where(left, i, j)

    while held * 2 <= span:
        least, at = join(at[:-held], at[held:], least[:-held], least[held:])
        held *= 2
    return join(at[:n], at[span - held : span - held + n], least[:n], least[span - held : span - held + n])


def _digest(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


ROWS = "doc_id long, d1 long, d2 long, n_words long, sha string, grams array<long>, places array<int>"


def text_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Every row: digest of its words, their number, the hash of the whole, and the grams that close its suffixes' prefixes."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = _words(text)
                joined = b" ".join(words)
                least, at = closing(grams_of(joined, gram), width, gram)
                close, n = np.unique(least[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else least, return_counts=True)
                rows.append((*_digest(words), len(words), hashlib.sha256(joined).hexdigest(), close.view(np.int64), n.astype(np.int32)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "d1", "d2", "n_words", "sha", "grams", "places"])

    return _plain(docs).mapInArrow(run, ROWS)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (doc_id, d1, d2, ...) with the texts of their doc_id; whose words have another digest, the caller leaves out."""
    rows = common.semi_by_id(_plain(docs), wanted, "doc_id")
    return wanted.withColumnRenamed("doc_id", "id").join(rows, F.col("id").eqNullSafe(F.col("doc_id"))).drop("id")


PLACES = "gram long, doc_id long, d1 long, d2 long, starts array<long>, windows int, words binary, r1 long, r2 long, hashes array<struct<h1:long,h2:long>>"


def places(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """A row for each run of suffixes closed by one place of a repeated gram: their words, or the windows' hashes where the gram has many places; these have a row for each text and words, with all starts."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, d1, d2, live, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "d1", "d2", "live", "text")), strict=True):
                words = _words(text)
                if _digest(words) != (d1, d2):
                    continue
                many = {x["gram"]: x["many"] for x in live}
                least, at = closing(grams_of(b" ".join(words), gram), width, gram)
                least = least.view(np.int64)
                again: dict[tuple[int, int], list[int]] = {}
                cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
                for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                    g = int(least[first])
                    if g not in many:
                        continue
                    if many[g]:
                        run = _digest(words[first : end - 1 + width])
                        if run in again:
                            again[run].append(int(first))
                            continue
                        again[run] = [int(first)]
                        pairs = [dict(zip(("h1", "h2"), _digest(words[i : i + width]), strict=True)) for i in range(first, end)]
                        out.append((g, doc_id, d1, d2, again[run], int(end - first), None, *run, pairs))
                    else:
                        out.append((g, doc_id, d1, d2, [int(first)], int(end - first), b" ".join(words[first : end - 1 + width]), None, None, None))
                if len(out) >= 1000:
                    yield _places(out)
                    out = []
            if out:
                yield _places(out)

    return texts.select("doc_id", "d1", "d2", "live", "text").mapInArrow(run, PLACES)


def _places(rows: list[tuple]) -> pa.RecordBatch:
    long = pa.int64()
    kinds = {"gram": long, "doc_id": long, "d1": long, "d2": long, "starts": pa.list_(long), "windows": pa.int32(), "words": pa.binary(), "r1": long, "r2": long, "hashes": pa.list_(pa.struct([("h1", long), ("h2", long)]))}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def subtrees(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of symbols, and the length of the common prefix of each with the one before: the suffix trees of all groups, the first symbol the group's."""
    n, width = suffixes.shape
    order = np.argsort(np.ascontiguousarray(suffixes.astype(">u4")).view(f"V{4 * width}").ravel(), kind="stable")
    ranked = suffixes[order]
    same = ranked[1:] == ranked[:-1]
    return order, np.concatenate([[0], np.where(same.all(axis=1), width, same.argmin(axis=1))]).astype(np.int64)


def deep_nodes(common_prefix: np.ndarray, depth: int) -> np.ndarray:
    """Where in the order the uppermost inner nodes of a depth or more begin; leaves without one are nodes of their own."""
    return np.flatnonzero(common_prefix < depth)


SPANS = "doc_id long, d1 long, d2 long, starts array<long>, length long"  # at each start so many words


def later_windows(group: np.ndarray, doc: np.ndarray, missing: np.ndarray, texts: list[bytes], windows: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each place, which of its windows stand in an earlier document too."""
    number: dict[bytes, int] = {}
    rows = []
    for g, text in zip(group, texts, strict=True):
        symbols = np.fromiter((number.setdefault(w, len(number)) for w in text.split(b" ")), dtype=np.uint32)
        view = np.lib.stride_tricks.sliding_window_view(symbols, width)
        rows.append(np.hstack([np.full((len(view), 1), g, dtype=np.uint32), view]))
    order, shared = subtrees(np.vstack(rows))
    nodes = deep_nodes(shared, width + 1)
    place = np.repeat(np.arange(len(texts)), windows)[order]
    first = np.minimum.reduceat(np.where(missing[place], _LAST, doc[place]), nodes)
    known = np.logical_or.reduceat(~missing[place], nodes)
    node = np.repeat(np.arange(len(nodes)), np.diff(np.concatenate([nodes, [len(order)]])))
    later = np.empty(len(order), dtype=bool)
    later[order] = np.where(missing[place], known[node], doc[place] > first[node])
    return np.split(later, np.cumsum(windows)[:-1])


def spans_of(later: np.ndarray, start: int, width: int) -> list[tuple[int, int]]:
    """Word ranges that flagged windows cover."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(later).tolist():
        if out and start + i <= out[-1][1]:
            out[-1] = (out[-1][0], start + i + width)
        else:
            out.append((start + i, start + i + width))
    return out


def tree_spans(found: DataFrame, width: int, batch: int) -> DataFrame:
    """Spans to remove, from the suffix trees of whole groups."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def build() -> pa.RecordBatch:
            gram, doc, d1, d2, starts, windows, words = zip(*held, strict=True)
            missing = np.array([d is None for d in doc])
            group = np.unique(np.array(gram, dtype=np.int64), return_inverse=True)[1]
            ids = np.array([_LAST if d is None else d for d in doc], dtype=np.int64)
            out = []
            for i, later in enumerate(later_windows(group, ids, missing, words, np.array(windows), width)):
                out.extend((doc[i], d1[i], d2[i], [a], b - a) for a, b in spans_of(later, starts[i][0], width))
            columns = zip(*out, strict=True) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if i == 3 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "d1", "d2", "starts", "length"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= batch and row[0] != held[-1][0]:
                    yield build()
                    held = []
                held.append(row)
        if held:
            yield build()

    cold = found.where("words IS NOT NULL").select("gram", "doc_id", "d1", "d2", "starts", "windows", "words")
    return cold.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPANS)


def _later(rows: DataFrame, key: list[str], folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of keys that also stand in a smaller doc_id, the others): the smallest of each key is found by partial aggregation."""
    sizes = common.stage(rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), folder, name)
    joined = common.stage(common.join_classes(rows, sizes, key, "size", rows.count()), folder, f"{name}-joined")
    later = "doc_id > first OR doc_id IS NULL AND first IS NOT NULL"
    return joined.where(later), joined.where(f"NOT coalesce({later}, false)")


def hashed_spans(found: DataFrame, width: int, folder: str) -> DataFrame:
    """Spans of places whose words, else of windows whose words, also stand in an earlier document."""
    span = lambda rows, shift, n: rows.select("doc_id", "d1", "d2", F.transform("starts", lambda x: x + shift).alias("starts"), n.cast("long").alias("length"))
    places = found.where("hashes IS NOT NULL").select("doc_id", "d1", "d2", "starts", "windows", "r1", "r2", "hashes")
    whole, first = _later(places, ["r1", "r2"], folder, "runs")
    each = first.select("doc_id", "d1", "d2", "starts", F.posexplode("hashes").alias("i", "h"))
    rows = common.stage(each.select("h.h1", "h.h2", "doc_id", "d1", "d2", "starts", "i"), folder, "hashed")
    return span(whole, F.lit(0), F.col("windows") - 1 + width).unionByName(span(_later(rows, ["h1", "h2"], folder, "sizes")[0], F.col("i"), F.lit(width)))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for start, end in spans:
        out += words[at:start]
        at = end
    return out + words[at:]


def removals(spark: SparkSession, docs: DataFrame, folder: str, width: int = WIDTH, gram: int = GRAM, contexts: int = CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(rows with the first doc_id of their words, spans to remove from these first ones), both written to the folder."""
    rows = common.stage(text_rows(docs, width, gram), folder, "rows")
    total = rows.count()
    classes = common.stage(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), folder, "classes")
    rows = common.stage(common.join_classes(rows, classes, ["d1", "d2"], "size", total), folder, "classified")
    reps = rows.where(F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "d1", "d2", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("doc_id", "d1", "d2", F.col("x.grams").alias("gram"), "x.places")
    several = reps.groupBy("gram").agg(*(f(c).alias(f"{c}_{n}") for c in ("d1", "d2") for n, f in (("least", F.min), ("most", F.max))), F.sum("places").alias("n"))
    live = common.stage(several.where("d1_least <> d1_most OR d2_least <> d2_most").select("gram", "n"), folder, "live")
    closed = common.join_classes(reps, live, ["gram"], "n", max(total, 1))
    wanted = closed.groupBy("doc_id", "d1", "d2").agg(F.collect_set(F.struct("gram", (F.col("n") > contexts).alias("many"))).alias("live"))
    wanted = common.stage(wanted, folder, "wanted")
    found = common.stage(places(_with_text(docs, wanted), width, gram), folder, "places")
    spans = tree_spans(found, width, BATCH).unionByName(hashed_spans(found, width, folder))
    return rows, common.stage(spans, folder, "spans")


CHANGED = "d1 long, d2 long, left long, left_sha string, kept string"


def dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH, gram: int = GRAM, contexts: int = CONTEXTS, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, dropped words removed; with texts, what is kept of the changed ones too (kept)."""
    common.small_batches(spark)
    folder = common.work_folder(spark, "repeats")
    rows, spans = removals(spark, docs, folder, width, gram, contexts)
    wanted = common.stage(spans.groupBy("doc_id", "d1", "d2").agg(F.collect_set(F.struct("starts", "length")).alias("spans")), folder, "by-text")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d1, d2, spans, text in zip(*(b.column(c).to_pylist() for c in ("d1", "d2", "spans", "text")), strict=True):
                words = _words(text)
                if _digest(words) == (d1, d2):
                    kept = kept_words(words, merged_spans([(a, a + x["length"]) for x in spans for a in x["starts"]]))
                    joined = b" ".join(kept)
                    out.append((d1, d2, len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if texts else None))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["d1", "d2", "left", "left_sha", "kept"])

    changed = _with_text(docs, wanted).select("d1", "d2", "spans", "text").mapInArrow(run, CHANGED).dropDuplicates(["d1", "d2"])
    changed = common.stage(changed, folder, "changed")
    first = F.col("doc_id").eqNullSafe(F.col("first"))
    one = rows.where(first).join(changed, ["d1", "d2"], "left")
    gone = F.when(F.col("n_words") >= width, F.col("n_words")).otherwise(F.lit(0))
    all_gone = rows.where(~first).select("doc_id", "n_words", gone.alias("n_removed"), F.when(F.col("n_words") >= width, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"), F.when(F.col("n_words") >= width, F.lit("")).alias("kept"))
    out = one.select("doc_id", "n_words", (F.col("n_words") - F.coalesce("left", "n_words")).alias("n_removed"), F.coalesce("left_sha", "sha").alias("kept_sha256"), "kept").unionByName(all_gone)
    return out if texts else out.drop("kept")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, common.parquet(spark, sf_dir, "documents"))


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50),
windows AS (SELECT r, doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (k) WHERE doc_id > first),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""
