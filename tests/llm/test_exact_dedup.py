import hashlib
import os

import numpy as np
from pyspark.sql import types as T

from wayfold.llm import common, exact_dedup, fuse

SCHEMA = "doc_id long, text string, digest string, n int"


def brute(rows):
    groups = {}
    for i, t in rows:
        key = (t or "").encode().lower()
        groups.setdefault(key, []).append(-1 if i is None else i)
    return groups


def check(spark, rows, digest=exact_dedup.sha256):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = exact_dedup.dedup(spark, docs, digest).collect()
    groups = brute(rows)
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        group = by_sha[r.text_sha256]
        assert r.group_size == len(group)
        assert (-1 if r.keep_id is None else r.keep_id) == max(group)


def test_equal_texts_and_odd_rows(spark):
    check(spark, [(i, f"Text {i % 7}".upper() if i % 2 else f"Text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (102, "É"), (103, "é"), (100, None), (None, "null id"), (5, "Text 5"), (104, "x" * 300_000)])


def test_a_digest_that_many_texts_share(spark):
    check(spark, [(i, f"t{i % 9}") for i in range(50)], digest=lambda b: hashlib.sha256(b).digest()[:1][:0] + bytes([len(b)]))


def test_one_hot_group(spark):
    check(spark, [(i, "same" if i % 3 else f"other {i}") for i in range(3000)])


def test_empty(spark):
    assert exact_dedup.dedup(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_fuse_filter():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = fuse.build(keys)
        assert fuse.contains(f, keys).all()
        other = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert fuse.contains(f, other).mean() < 0.02
        if n == 50_000:
            assert len(f) < 1.4 * n


def test_scratch_drops_what_was_made_inside(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x", 1), (2, "A", "x", 1)], SCHEMA)
    local = lambda uri: uri.removeprefix("file:").replace("//", "/")
    before = common.work_folder(spark, "outside")
    with common.scratch():
        outer = common.work_folder(spark, "outer")
        common.stage(docs, outer, "t")
        with common.scratch():
            inner = common.work_folder(spark, "inner")
            common.stage(docs, inner, "t")
            unused = common.work_folder(spark, "unused")
            kept = common.stage(exact_dedup.keep(spark, docs), before, "t")
        assert os.path.isdir(local(outer)) and not os.path.exists(local(inner)) and not os.path.exists(local(unused))
    assert not os.path.exists(local(outer))
    assert [r.doc_id for r in kept.collect()] == [2]
    try:
        with common.scratch():
            failed = common.work_folder(spark, "failed")
            common.stage(docs, failed, "t")
            raise RuntimeError("a stage fails")
    except RuntimeError:
        assert not os.path.exists(local(failed))
