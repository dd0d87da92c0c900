import random

import numpy as np
import pytest

from wayfold.llm import hamming, jaccard_join


@pytest.mark.parametrize("bits,n", [(64, 700), (12, 300), (64, 6)])
def test_hamming_is_exact(spark, bits, n):
    rng = np.random.default_rng(bits)
    centres = rng.normal(size=(5, bits))
    v = (centres[rng.integers(0, 5, n)] + rng.normal(size=(n, bits))).astype(np.float32)
    v[n // 3 : n // 2] = v[0]  # a hot vector
    v[1, 0], v[2, 1], v[3, 2] = np.nan, 0.0, -0.0
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(n, None, 1), (n + 1, [1.0], 1), (0, v[0].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance int")
    got = {}
    for r in hamming.search(spark, frame, frame.where("vec_id % 20 = 0"), 10, bits).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    every = [(i, (np.array(x) > 0) | np.isnan(x)) for i, x, _ in rows if x and len(x) == bits]
    for q in {i for i, *_ in every if i % 20 == 0}:
        code = dict(every)[q]
        want = sorted((int((code != c).sum()), i) for i, c in every)[:10]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(want)]
    assert hamming.search(spark, frame.limit(0), frame.limit(0), 10, bits).collect() == []


def test_bits_that_have_no_code(spark):
    for bits in (0, 65):
        with pytest.raises(ValueError):
            hamming.codes(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), bits)


def test_more_index_blocks_than_one(spark, monkeypatch):
    monkeypatch.setattr(hamming, "INDEX_BLOCK", 50)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 7)
    test_hamming_is_exact(spark, 12, 300)


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                n = len(s[i] & s[j])
                if n >= 0.8 * (len(s[i]) + len(s[j]) - n) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[root(i)] = min(lowest.get(root(i), 10**18), d)
    return sorted((d, lowest[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups, size, words):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small,block", [(32, 256), (4, 8)])
def test_jaccard_join(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_copies(1, 15, 3, 80) + near_copies(2, 1, 60, 60) + ["same text of more than five words"] * 25 + ["Same  TEXT of more than five words", "short one", "SHORT one", "", None, " \n ", "a b c d e f"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_links int, node string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(spark, frame).collect())
    assert got == brute(rows)


def test_jaccard_join_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(spark, frame).collect() == []


def test_the_search_ends_where_the_links_say():
    chance = lambda k, s: 1 - (1 - s**k) ** jaccard_join.TREES
    assert chance(jaccard_join.floor_depth(), 0.8) >= 0.99999 > chance(jaccard_join.floor_depth() + 1, 0.8)
    top, low = {jaccard_join.BINS - 1: 10**6}, {0: 10**6}
    assert jaccard_join.enough(8, top) and not jaccard_join.enough(8, low) and not jaccard_join.enough(8, {})
    ends = lambda links: next(d for d in range(8, 0, -1) if jaccard_join.enough(d, links))
    assert ends(top) > ends({4: 10**6}) >= ends(low) >= jaccard_join.floor_depth()


def test_recall_of_links_at_the_threshold(spark):
    rng = random.Random(3)
    rows, want = [], 0
    for i in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(230)]
        k = rng.randrange(12, 24)
        pair = [" ".join(words[:204]), " ".join(words[k : 204 + k])]
        a, b = map(sets, pair)
        want += len(a & b) >= 0.8 * len(a | b)
        rows += [(2 * i + j, x) for j, x in enumerate(pair)]
    got = jaccard_join.join(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0").count() / 2
    assert want > 1000 and 0.999 * want <= got <= want


def test_the_forest_is_in_order_and_knows_its_company(spark):
    texts = near_copies(4, 40, 3, 60)
    nodes = jaccard_join.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("node IS NOT NULL").dropDuplicates(["node"])
    rows = [(r.tree, bytes(r.label), r.deep, bytes(r.node)) for r in jaccard_join.forest(nodes, 4).collect()]
    sig = {bytes(r.node): bytes(r.sig) for r in nodes.collect()}
    labels = [[s[16 * t : 16 * t + 16] for s in sig.values()] for t in range(jaccard_join.TREES)]
    shared = lambda a, b: next((i for i in range(8) if a[2 * i : 2 * i + 2] != b[2 * i : 2 * i + 2]), 8)
    for tree, label, deep, node in rows:
        assert sig[node][16 * tree : 16 * tree + 16] == label
        assert deep >= sorted(shared(label, x) for x in labels[tree])[-2]
    want = {(t, n) for t in range(jaccard_join.TREES) for n, s in sig.items() if sorted(shared(s[16 * t : 16 * t + 16], x) for x in labels[t])[-2] >= 4}
    assert want <= {(t, n) for t, *_, n in rows}
    assert len(rows) - len(want) <= 2 * spark.sparkContext.defaultParallelism * 4
