"""N-best SentencePiece segmentation: forward Viterbi, then backward A-star.

A segmentation's score is the sum of its pieces' scores in the model. A forward
Viterbi pass gives the best score of every prefix; a backward search from the end
uses these as exact heuristics, so hypotheses reach the start in order of total
score and the first n of them are the n best.

No piece crosses a boundary between two characters that stand side by side in no
piece, so a text falls into independent segments. The forward pass gives each
segment's best and what its second best loses; of a text's segments only the n - 1
that lose least can differ from their best in its n best, so the backward search
runs over these, in each segment and then over the text.

A character without a piece becomes its byte pieces at a score ten below the
model's least. Encoding puts the model's space mark for spaces and before the
text. A null or empty text has one segmentation, of no pieces. Repeated rows are
encoded each. Segmentations of equal score come in the order in which the search
finds them, which depends on the text alone. Other columns are not read. An empty
table gives an empty result.

Decoding joins the pieces, reads space marks as spaces and takes the first one
off, so a literal mark of the text comes back as a space, as in the library. Ids
that the model hasn't become U+FFFD.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "\u2581"
#: Segments that a worker remembers at most; then it starts afresh.
REMEMBERED = 400_000
NO_LOSS = float("inf")
_open: dict[tuple[str, int], Segmenter] = {}

#: Of a segment: the best score, its ids, and what the second best loses.
First = tuple[float, bytes, float]


class Segmenter:
    def __init__(self, path: str, n: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes_of = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = (sp.get_score(i), i)
        self.said = ["\ufffd".encode()] * sp.get_piece_size()  # what each id decodes to
        for piece, (_, i) in self.pieces.items():
            self.said[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.bytes_of.items():
            self.said[i] = bytes([byte])
        self.unknown_id = sp.unk_id()
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        self.longest = max(map(len, self.pieces))
        self.pairs = {a + b for p in self.pieces for a, b in itertools.pairwise(p)}
        # runs of letters or of other characters with the marks before them, where pieces hold to that
        alone = "".join(regex.escape(c) for c in "\n\t\r" if not any(c in x for x in self.pairs))
        letter = regex.compile(r"[\p{L}\p{M}]").match
        apart = all(x[0] == MARK or x[1] != MARK and bool(letter(x[0])) == bool(letter(x[1])) for x in self.pairs)
        self.words = regex.compile(rf"{MARK}*+[\p{{L}}\p{{M}}]++|{MARK}*+[^\p{{L}}\p{{M}}{MARK}{alone}]++|{MARK}++" + (f"|[{alone}]" if alone else "")).findall if apart else None
        self.known: dict[str, First] = {}
        self.more: dict[str, list[tuple[float, bytes]]] = {}
        self.trie: dict = {}  # of characters to (the same of what follows, the piece's score and id or None)
        for piece, found in sorted(self.pieces.items()):
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[piece[-1]] = (node.get(piece[-1], ({}, None))[0], found)

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def fallback(self, c: str) -> list[int]:
        found = [self.bytes_of.get(b, self.unknown_id) for b in c.encode("utf-8", "surrogatepass")]
        return [self.unknown_id] if self.unknown_id in found else found

    def lattice(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the edges (start, score, ids) into it."""
        get, longest = self.pieces.get, self.longest
        into = []
        for j in range(len(s) + 1):
            edges = []
            for i in range(max(0, j - longest), j):
                if found := get(s[i:j]):
                    edges.append((i, found[0], (found[1],)))
            if j and s[j - 1] not in self.pieces:
                edges.append((j - 1, self.unknown, tuple(self.fallback(s[j - 1]))))
            into.append(edges)
        return into

    def search(self, s: str) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a string: Viterbi forwards, A-star backwards."""
        into = self.lattice(s)
        best = [0.0] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            best[j] = max(best[i] + w for i, w, _ in into[j])
        out, order = [], itertools.count()
        heap = [(-best[-1], next(order), len(s), 0.0, None)]
        visits = [0] * (len(s) + 1)
        while heap and len(out) < self.n:
            _, _, at, behind, path = heapq.heappop(heap)
            if visits[at] == self.n:
                continue  # n better hypotheses have left this place
            visits[at] += 1
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((behind, ids))
                continue
            for i, w, piece in into[at]:
                heapq.heappush(heap, (-(best[i] + w + behind), next(order), i, w + behind, (piece, path)))
        return out

    def viterbi(self, s: str) -> tuple[float, list[int], float]:
        """The best score, its ids, and what the second best loses.

        A path that isn't the best leaves it at some place by another edge; the
        least loss at any place of the best path is the second best's."""
        n = len(s)
        best, second, back = [0.0] + [-NO_LOSS] * n, [-NO_LOSS] * (n + 1), [(0, 0)] * (n + 1)
        trie = self.trie
        for i in range(n):
            here, kids, j = best[i], trie, i
            while j < n:
                node = kids.get(s[j])
                if node is None:
                    break
                j += 1
                kids, piece = node
                if piece:
                    v = here + piece[0]
                    if v > best[j]:
                        second[j], best[j], back[j] = best[j], v, (i, piece[1])
                    elif v > second[j]:
                        second[j] = v
            if s[i] not in self.pieces:
                v = here + self.unknown
                if v > best[i + 1]:
                    second[i + 1], best[i + 1], back[i + 1] = best[i + 1], v, (i, -1)
                elif v > second[i + 1]:
                    second[i + 1] = v
        ids: list[int] = []
        loss, at = NO_LOSS, n
        while at:
            loss = min(loss, best[at] - second[at])
            i, piece = back[at]
            if piece < 0:
                ids += self.fallback(s[i])[::-1]
            else:
                ids.append(piece)
            at = i
        return best[n], ids[::-1], loss

    def first(self, s: str) -> First:
        found = self.known.get(s)
        if not found:
            score, ids, loss = self.viterbi(s)
            found = self.known[s] = score, array("I", ids).tobytes(), loss
        return found

    def others(self, s: str) -> list[tuple[float, bytes]]:
        """(loss, ids) of the second to nth best; searched for segments that a text's n best can change."""
        found = self.more.get(s)
        if found is None:
            ranked = self.search(s)
            found = self.more[s] = [(ranked[0][0] - score, array("I", ids).tobytes()) for score, ids in ranked[1:]]
        return found

    def combine(self, words: list[str], firsts: list[First]) -> list[tuple[float, bytes]]:
        """The n best of independent segments: only the n - 1 with the least second losses can differ from their best."""
        score, ids = sum([x[0] for x in firsts]), [x[1] for x in firsts]
        losses = [x[2] for x in firsts]
        open_ = sorted(i for i in heapq.nsmallest(self.n - 1, range(len(firsts)), key=losses.__getitem__) if losses[i] < NO_LOSS)
        out, order = [], itertools.count()
        heap: list[tuple] = [(0.0, next(order), len(open_), ())]  # (loss so far, exact since the best of the rest loses nothing)
        while heap and len(out) < self.n:
            loss, _, left, chosen = heapq.heappop(heap)
            if not left:
                changed = ids
                if chosen:
                    changed = list(ids)
                    for i, piece in chosen:
                        changed[i] = piece
                out.append((score - loss, b"".join(changed)))
                continue
            i = open_[left - 1]
            heapq.heappush(heap, (loss, next(order), left - 1, chosen))
            for more, piece in self.others(words[i]):
                heapq.heappush(heap, (loss + more, next(order), left - 1, (*chosen, (i, piece))))
        return out

    def n_best(self, text: str) -> list[tuple[float, bytes]]:
        """(score, little-endian 32-bit ids) of the n best segmentations of a whole text."""
        s = self.normal(text)
        if not s:
            return [(0.0, b"")]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.more) > REMEMBERED // 4:
            self.more.clear()
        known, words = self.known, self.words(s) if self.words else [s]
        try:
            firsts = [known[w] for w in words]
        except KeyError:
            firsts = [known.get(w) or self.first(w) for w in words]
        return self.combine(words, firsts)

    def decode(self, ids: Sequence[int]) -> str:
        try:
            out = b"".join(map(self.said.__getitem__, ids))
        except IndexError:
            out = b"".join(self.said[i] if i < len(self.said) else self.said[self.unknown_id] for i in ids)
        return out.decode("utf-8", "replace").removeprefix(" ")


def segmenter(path: str, n: int) -> Segmenter:
    if (path, n) not in _open:
        _open[path, n] = Segmenter(path, n)
    return _open[path, n]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def n_best(docs: DataFrame, path: str, n: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids_crc32, decoded), a row for each of the n best segmentations there are.

    decoded says whether its ids decode to the whole text, space marks read as
    spaces. With with_ids the rows hold the ids too, for decode()."""
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decoded"]
    schema = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decoded boolean"
    if with_ids:
        kinds, names, schema = [*kinds, pa.list_(pa.int32())], [*names, "ids"], schema + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path, n)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), common.strings(b.column(1)), strict=True):
                plain = text.replace(MARK, " ")
                for rank, (score, ids) in enumerate(seg.n_best(text), 1):
                    numbers = array("I", ids)
                    row = (doc_id, rank, score, len(numbers), zlib.crc32(ids), seg.decode(numbers) == plain)
                    out.append((*row, numbers.tolist()) if with_ids else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """The rows with the text that their ids (array of whole numbers) stand for; null ids give null, a null or unknown id U+FFFD."""
    at = rows.columns.index(ids)
    rows = rows.withColumn(ids, F.col(ids).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path, 1)
        for b in batches:
            texts = [None if x is None else seg.decode([seg.unknown_id if i is None or i < 0 else i for i in x]) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, into])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{into}` string"])
    return rows.mapInArrow(run, fields)


def op5_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return n_best(common.parquet(spark, sf_dir, "documents"), default_path(), 4)
