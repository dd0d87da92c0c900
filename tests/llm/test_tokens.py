import functools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from wayfold.llm import packing, token_records
from wayfold.llm.encode import default_path, encoder

TEXTS = ["", None, "Hello  world\n\n it's 12 x", "<|endoftext|> as a token", "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endoftext", "<|endoftext|>", "Été 你好 \U0001f600 a b", "word " * 30_000, "a", "a"]


@functools.cache
def library():
    return Tokenizer.from_file(default_path())


def direct(text):
    return library().encode(text or "", add_special_tokens=False).ids


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "c", 0) for i, t in reversed(list(enumerate(texts)))], "doc_id long, text string, start string, n_tokens int")


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_ids_equal_the_librarys():
    enc = encoder(default_path())
    for text, data in zip(TEXTS, enc.encode([t or "" for t in TEXTS]), strict=True):
        assert enc.ids(data).tolist() == direct(text)


def test_records_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    got = token_records.round_trip(spark, docs(spark), default_path(), folder=folder).orderBy("doc_id").collect()
    start = 0
    for i, (r, text) in enumerate(zip(got, TEXTS, strict=True)):
        ids = [*direct(text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
    # the index allows reads in any order
    import pyarrow.parquet as pq

    for m in spark.read.parquet(folder + "/manifest").collect():
        index = pq.read_table(f"{tmp_path}/out/tokens-{m.shard:06d}.idx").to_pylist()
        for x in reversed(index):
            doc_id, ids = token_records.read_at(folder, m.shard, x["byte_offset"])
            assert doc_id == x["doc_id"] and ids.tolist() == [*direct(TEXTS[doc_id]), 2]


def test_damage_is_seen(tmp_path):
    import io

    data = bytearray(token_records.frame(b"payload"))
    assert token_records.read_frame(io.BytesIO(bytes(data))) == b"payload"
    for at in (0, 9, 13, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        token_records.read_frame(io.BytesIO(bytes(data[:-2])))


def test_empty(spark):
    none = docs(spark).limit(0)
    assert token_records.round_trip(spark, none, default_path()).collect() == []
    assert packing.pack(spark, none, default_path()).collect() == []


def verify(rows, tokens, documents, attention):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= tokens and len(b) <= documents and sum(n * n for _, n in b) <= attention
    return len(bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(256, 256, 256 * 256), (256, 3, 40_000)])
def test_packing(spark, caps, score):
    texts = [*TEXTS, *("w" + " and" * (i * 37 % 240) for i in range(300))]
    got = packing.pack(spark, docs(spark, texts), default_path(), tokens=caps[0], documents=caps[1], attention=caps[2], score=score).collect()
    verify(got, *caps)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, rs in by_doc.items():
        ids, at = [*direct(texts[i]), 0], 0
        for j, r in enumerate(sorted(rs, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (j, at, crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_many_first_ranks_are_joined_by_a_shuffle(spark, monkeypatch):
    table = docs(spark, [*TEXTS, *("w" + " and" * (i * 37 % 240) for i in range(300))]).repartition(5, "doc_id")
    broadcast = packing.pack(spark, table, default_path())
    monkeypatch.setattr(packing, "SMALL_STARTS", 10)
    shuffled = packing.pack(spark, table, default_path())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(broadcast) and "SortMergeJoin" in plan(shuffled) and "BroadcastHashJoin" not in plan(shuffled)
    key = lambda r: (r.doc_id, r.piece)
    assert sorted(broadcast.collect(), key=key) == sorted(shuffled.collect(), key=key)
    verify(shuffled.collect(), 2048, 2048, 2048 * 2048)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    sizes, many = np.unique(np.clip(rng.lognormal(6.3, 1, 200_000).astype(int), 1, 2048), return_counts=True)
    counts = dict(zip(sizes.tolist(), many.tolist(), strict=True))
    p = packing.plan(counts, 2048, 2048, 2048 * 2048)
    assert p["sequences"] <= 1.002 * sum(s * c for s, c in counts.items()) / 2048 + 1
