import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import common, divergence, radix

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, ws = lang or "", source or "", WORD.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(ws))
        counts[lang, source].update(ws)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in every.items()}, share({t: sum(c[t] for c in every.values()) for t in kept})
        for s in sources:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            told = [(p[s][t] - q[t], t) for t in kept if every[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", far, None), ("term", told, top)):
                for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, i + 1))
    return sorted(out)


def made(n=300):
    rng = random.Random(5)
    words = ["alpha", "Alpine", "été", "étés", "beta", "bet", "你好", "x" * 300, "don't", "tie", "toe", "a1b"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s1", "S2", None])) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "de", "only"), ("rare words here", "de", "other"), ("q" * 200_000 + " beta", "en", "s9"), ("beta beta", "en", "s0"), ("beta beta", "en", "s0")]


def frame(spark, rows):
    return spark.createDataFrame([(t, x, s, 1, "r") for t, x, s in rows], "text string, lang string, source string, value int, part string")


@pytest.mark.parametrize(("most_leaves", "block"), [(200_000, 512), (2, 2)])
def test_equal_to_brute_force(spark, monkeypatch, most_leaves, block):
    rows = made()
    if block == 2:  # tries are written out at once, prefixes cut down to whole terms, pairs in blocks of two
        for name, x in (("COUNTED", 3), ("HELD", 3), ("CHUNK", 2)):
            monkeypatch.setattr(divergence, name, x)
    got = divergence.audit(spark, frame(spark, rows).repartition(5), least=3, top=4, most_leaves=most_leaves, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 4)


def test_empty_table(spark):
    assert divergence.audit(spark, frame(spark, [])).collect() == []


def test_large_totals_stay_exact():
    import numpy as np

    for total in (10**6, 2**63 // 1000 - 100, 2**53 * 3):
        counts = np.array([0, 1, total // 3, total - 7], dtype=np.int64)
        assert divergence.shares(counts, total, 10).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 50) for c in counts]


def test_tries_merge_cut_and_travel():
    rng = random.Random(2)
    terms = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randint(1, 12))) for _ in range(500)] + [b"ab", b"a", b"abc" * 50_000]
    whole, parts = Counter(), [radix.Trie() for _ in range(3)]
    for t in terms * 2:
        source = rng.randint(0, 3)
        whole[t, source] += 1
        rng.choice(parts).add(t, source, 1)
    one = radix.Trie()
    for p in parts:
        assert [t for t, _ in p.items()] == sorted({t for t, _ in p.items()}) and p.leaves == sum(1 for _ in p.items())
        for prefix, held in radix.pieces(p.items(), 2):
            assert all(t[:2] == prefix for t, _ in held)
            one.merge(radix.pack(held))
    assert {(t, c): n for t, leaf in one.items() for c, n in leaf.items()} == dict(whole)


def test_deep_cuts_end(spark):
    folder = common.work_folder(spark, "cuts")
    rows = [(f"{'z' * 40}{'a' * (i % 7)}", "en", f"s{i % 3}") for i in range(90)]
    ids = {("en", f"s{i}"): i for i in range(3)}
    pieces = common.stage(divergence.count_tries(frame(spark, rows).repartition(6), ids), folder, "pieces")
    cut = divergence.cut_deeper(pieces, folder, 1)
    assert cut.where("leaves > 1").isEmpty()
    assert divergence.kept_terms(cut, 1).count() == 7


class Batches:
    """Stands for a table: gives the function that counts its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_counting_takes_no_more_than_three_times_plain_counters(spark):
    rng = random.Random(7)
    often = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    text = lambda: " ".join(rng.choices(often, k=240) + ["".join(rng.choices("klmnopqr", k=9)) for _ in range(60)])
    rows = [(text(), "en", f"s{i % 20:02}") for i in range(4000)]
    ids = {("en", f"s{i:02}"): i for i in range(20)}
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 500], strict=True)], ["text", "lang", "source"]) for i in range(0, len(rows), 500)]

    def plain():
        counts, docs = defaultdict(Counter), Counter()
        for b in batches:
            for t, _, source in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ws = t.encode().translate(divergence._LETTERS).split()
                counts[source].update(ws)
                docs.update(set(ws))
        return counts, docs

    def cpu(run):
        times = []
        for _ in range(3):
            began = time.process_time()
            out = run()
            times.append(time.process_time() - began)
        return min(times), out

    took, out = cpu(lambda: list(divergence.count_tries(Batches(), ids)(iter(batches))))
    least, (counts, docs) = cpu(plain)
    whole = radix.Trie()
    for b in out:
        for data in b.column(3).to_pylist():
            whole.merge(data)
    got = dict(whole.items())
    assert {t: leaf.pop(divergence.DOCS) for t, leaf in got.items()} == docs
    assert {(t, f"s{c:02}"): n for t, leaf in got.items() for c, n in leaf.items()} == {(t, s): n for s, x in counts.items() for t, n in x.items()}
    assert took < 3 * least


def test_terms_of_neighbouring_texts_stay_apart():
    texts = pa.array(["pad", "ab", "", "cd ab", "1", "AB\tcd", "é ab", ""])[1:]
    terms, place, counter, n = divergence.count_terms(texts, np.array([3, 0, 3, 1, 0, 3, 0]))
    terms = terms.to_pylist()
    got = {(terms[p], c): k for p, c, k in zip(place.tolist(), counter.tolist(), n.tolist(), strict=True)}
    docs = divergence.DOCS
    assert got == {(b"ab", 3): 3, (b"cd", 3): 1, (b"ab", 0): 1, (b"cd", 0): 1, ("é".encode(), 3): 1, (b"ab", docs): 4, (b"cd", docs): 2, ("é".encode(), docs): 1}
    assert len(got) == len(n)


def test_parts_of_batches_and_joint_prefixes(spark, monkeypatch):
    for name, x in (("PART", 50), ("TOGETHER", 1)):
        monkeypatch.setattr(divergence, name, x)
    rows = made()
    got = divergence.audit(spark, frame(spark, rows).repartition(3), least=3, top=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 4)


def test_counters_are_summed_when_many(monkeypatch):
    monkeypatch.setattr(radix, "SUMMED", 10)
    rng, trie, whole = random.Random(3), radix.Trie(), Counter()
    for _ in range(60):
        terms = [bytes(rng.choices(b"ab", k=rng.randint(1, 7))) for _ in range(8)]
        counters, n = [rng.randint(0, 2) for _ in terms], [rng.randint(1, 2**40) for _ in terms]
        trie.insert(terms, np.ones(8, dtype=np.int64), np.array(counters), np.array(n))
        for t, c, k in zip(terms, counters, n, strict=True):
            whole[t, c] += k
    assert trie.held < 3 * len(whole)
    assert {(t, c): n for t, leaf in trie.items() for c, n in leaf.items()} == dict(whole)
    leaves = trie.traverse()
    assert leaves.terms == sorted(leaves.terms) and leaves.shares.tolist() == [radix.shared(a, b) for a, b in zip([b"", *leaves.terms], leaves.terms, strict=False)]
    assert dict(radix.unpack(radix.pack(leaves)).each()) == dict(leaves.each())


def test_a_piece_is_written_again_only_if_cut(spark):
    folder = common.work_folder(spark, "cuts")
    rows = [(f"{'z' * 40}{'a' * (i % 7)} other{chr(97 + i % 5)}", "en", "s") for i in range(90)]
    pieces = common.stage(divergence.count_tries(frame(spark, rows).repartition(6), {("en", "s"): 0}), folder, "pieces")
    cut = divergence.cut_deeper(pieces, folder, 31)
    assert divergence.kept_terms(cut, 1).count() == 12
    assert {r.prefix for r in cut.where("prefix < 'z'").collect()} == {b"oth"}
