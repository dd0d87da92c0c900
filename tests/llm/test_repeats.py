import hashlib
import random
import re

import numpy as np
import pytest

from wayfold.llm import repeats

WORD = re.compile("[^\x20\x09-\x0d]+")
INFINITE = 2**70


def brute(rows, width):
    """By the definition: windows as tuples, the least doc_id of each."""
    first = {}
    texts = [(INFINITE if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for order, _, ws in texts:
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i : i + width])
            first[k] = min(first.get(k, order), order)
    out = []
    for order, doc_id, ws in texts:
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < order:
                gone.update(range(i, i + width))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "été", "A", " ", "zz."]
    passage = [" ".join(rng.choices(words, k=rng.randint(6, 40))) for _ in range(6)]
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(rng.choice([*passage, " ".join(rng.choices(words + ["q%d" % i], k=rng.randint(0, 9)))]) for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(-50, 400), n)]
    rows += [(1000, None), (1001, ""), (None, passage[0]), (None, passage[0] + " tail"), (7000, passage[1]), (7000, passage[1]), (7000, "x " + passage[1]), (5, passage[2])]
    rows += [(2000 + i, "word " * 60) for i in range(3)] + [(3000 + i, "word " * (30 + i)) for i in range(3)] + [(4000, "long" * 40_000 + " a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "gram", "contexts"), [(1, 6, 2, 1500), (2, 6, 3, 3), (3, 5, 5, 0), (4, 9, 1, 8)])
def test_equal_to_brute_force(spark, monkeypatch, seed, width, gram, contexts):
    monkeypatch.setattr(repeats, "BATCH", 7)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, 1, "g", 2) for i, t in rows], "doc_id long, text string, n_words int, gram string, first int").repartition(5)
    got = repeats.dedup(spark, docs, width, gram, contexts, texts=True).collect()
    want = brute(rows, width)
    assert any(n for _, _, n, _, _ in want)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted((x[:4] for x in want), key=str)
    texts = {x[3]: " ".join(x[4]) for x in want}
    assert all(r.kept is None or r.kept == texts[r.kept_sha256] for r in got)


def test_empty_table(spark):
    assert repeats.dedup(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_closing_grams_depend_on_the_window_alone():
    rng = random.Random(9)
    words = [rng.choice("abcdefgh").encode() * rng.randint(1, 3) for _ in range(400)]
    whole, at = repeats.closing(repeats.grams_of(b" ".join(words), 3), 12, 3)
    for i in rng.sample(range(len(whole)), 60):
        one, where = repeats.closing(repeats.grams_of(b"\n\t".join(words[i : i + 12]), 3), 12, 3)
        assert one.tolist() == [whole[i]] and where[0] == at[i] - i


def test_trees_give_maximal_depths():
    rng = random.Random(4)
    rows = np.array([[rng.randint(0, 2) for _ in range(6)] for _ in range(200)], dtype=np.uint32)
    order, shared = repeats.subtrees(rows)
    ranked = [tuple(x) for x in rows[order].tolist()]
    assert ranked == sorted(map(tuple, rows.tolist()))
    for i in range(1, len(ranked)):
        n = next((k for k in range(6) if ranked[i][k] != ranked[i - 1][k]), 6)
        assert shared[i] == n
    for depth in (2, 4, 6):
        nodes = repeats.deep_nodes(shared, depth)
        assert len(nodes) == len({x[:depth] for x in ranked})
