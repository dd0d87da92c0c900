import itertools
import random
import zlib

import numpy as np
import sentencepiece

from wayfold.llm import segmentation


def brute(seg, text, n):
    s = seg.normal(text)
    found = []

    def walk(at, score, ids):
        if at == len(s):
            found.append((score, tuple(ids)))
            return
        for end in range(at + 1, min(len(s), at + seg.longest) + 1):
            piece = seg.pieces.get(s[at:end])
            if piece:
                walk(end, score + piece[0], [*ids, piece[1]])
        if s[at] not in seg.pieces:
            walk(at + 1, score + seg.unknown, [*ids, *seg.fallback(s[at])])

    walk(0, 0.0, [])
    return sorted((x[0] for x in found), reverse=True)[:n], {x[1] for x in found}


def test_n_best_is_exact():
    rng = random.Random(2)
    for n in (1, 2, 4, 7):
        seg = segmentation.Segmenter(segmentation.default_path(), n)
        texts = ["", "a", "  ", "a  b", "the cat", "\n", "é你\U0001f600", "x\ny", "in the"]
        texts += ["".join(rng.choice("the an.,\ni") for _ in range(rng.randrange(1, 11))) for _ in range(60)]
        for text in texts:
            got = seg.n_best(text)
            if not text:
                assert got == [(0.0, b"")]
                continue
            scores, every = brute(seg, text, n)
            ids = [tuple(np.frombuffer(b, dtype="<u4").tolist()) for _, b in got]
            assert [round(s, 4) for s, _ in got] == [round(s, 4) for s in scores], text
            assert len(set(ids)) == len(ids) and set(ids) <= every
            assert all(seg.decode(x) == text for x in ids)
            assert all(a >= b for (a, _), (b, _) in itertools.pairwise(got))


def test_rows(spark):
    docs = spark.createDataFrame([(1, "some words here", 5), (2, None, 6), (2, None, 6), (3, "word " * 20_000, 7)], "doc_id long, text string, score int")
    got = segmentation.n_best(docs, segmentation.default_path(), 3).collect()
    seg = segmentation.Segmenter(segmentation.default_path(), 3)
    for i, text in ((1, "some words here"), (3, "word " * 20_000)):
        want = [(s, len(b) // 4, zlib.crc32(b)) for s, b in seg.n_best(text)]
        assert [(r.score, r.n_pieces, r.ids_crc32) for r in sorted(got, key=lambda r: r.rank) if r.doc_id == i] == want
    assert [(r.rank, r.score, r.n_pieces) for r in got if r.doc_id == 2] == [(1, 0.0, 0)] * 2
    assert segmentation.n_best(docs.limit(0), segmentation.default_path(), 3).collect() == []


def test_decoding(spark):
    path = segmentation.default_path()
    texts = ["some words here", "  two  spaces ", "\u00e9\u4f60\U0001f600\n\tx", "a\u2581b", "", None, "word " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = segmentation.n_best(docs, path, 3, with_ids=True)
    rows = segmentation.decode(found, path).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts))) and len(rows) > 2 * len(texts)
    for r in rows:
        assert r.text == (texts[r.doc_id] or "").replace("\u2581", " ") and r.decoded
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_pieces
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in rows:
        assert r.text == library.decode(r.ids)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**8, -1, None])], "k int, ids array<int>")
    assert [r.text for r in segmentation.decode(odd, path).orderBy("k").collect()] == [None, "", "\ufffd\ufffd\ufffd"]
    assert segmentation.decode(odd.limit(0), path).collect() == []
