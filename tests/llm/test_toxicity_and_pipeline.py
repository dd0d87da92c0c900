import os
import random

import pytest

from wayfold.llm import toxicity

SF = "/root/testdata/sf0.01"


def made(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["la", "to", "mi", "re", "su"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        bad = i % 6 == 0
        for _ in range(rng.randrange(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumpf", "blorgh" + rng.choice(["a", "en", "ist"])]))
        rows.append((i, " ".join(words) + "!%$" * (5 if i % 4 == 0 else 0), "s"))
        labels.append((i, int(i % 4 != 0), int(bad)))
    return rows, labels


def test_chain_on_held_out_rows(spark):
    rows, labels = made(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    known = spark.createDataFrame([x for x in labels if x[0] < 600], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(spark, docs, known).collect()}
    held = [x for x in labels if x[0] >= 600]
    assert sum(got[i].toxic_found == bool(t) for i, _, t in held) >= 0.98 * len(held)
    assert sum((got[i].p_quality > 0.5) == bool(q) for i, q, _ in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000), (None, "y"), (3, "z")], "doc_id long, text string")
    for labels in ([], [(1, 1, 0), (3, None, 0)], [(1, 0, 1), (2, 1, 0), (2, 1, 1), (None, 1, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert toxicity.classify(spark, docs, known).count() == 5
        assert toxicity.classify(spark, docs.limit(0), known).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P
    from wayfold.llm import pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept, seen = docs, []
    for _, stage in P.STAGES:
        out = stage(spark, kept, SF).collect()
        kept = spark.createDataFrame(out, out[0].__class__ and kept.schema) if "text" in out[0] else None
        seen.append(out)
    toxic, exact, near, private, packed = seen
    assert 0.8 * len(rows) < len(toxic) < len(rows)
    # exact dedup against brute force on its own input
    best = {}
    for r in toxic:
        k = (r.text or "").encode().lower()
        best[k] = max(best.get(k, -1), r.doc_id)
    assert {r.doc_id for r in exact} == set(best.values()) and len(exact) == len(best)
    assert {r.doc_id for r in near} <= {r.doc_id for r in exact} and len(near) < len(exact)
    by_id = {r.doc_id: r for r in near}
    assert len(private) == len(near)
    for r in private:
        assert (r.text == by_id[r.doc_id].text) == (not pii.detect(by_id[r.doc_id].text or ""))
    assert {r.doc_id for r in packed} == set(by_id)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Each stage against a plain computation on its own input."""
    import public_tokenizers
    from test_search_and_joins import brute
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from wayfold.llm import common, pii

    rows, labels = made(240)
    texts = {i: t for i, t, _ in rows}
    odd = [(1000, None), (1001, ""), (1002, None), (1003, texts[1].upper()), (1004, texts[3] + " extra"), (1005, "word " * 30_000)]
    odd += [(1006, "Mr James Smith wrote to ann@corp.com from 10.1.2.3"), *[(1007, "the same row twice in one table")] * 2, (None, "no id at all on this row")]
    whole = [(i, t, "en", "s", None if t is None else len(t), True, i, "x", 0.5) for i, t in [*((i, t) for i, t, _ in rows), *odd]]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class_id long, digest string, p_toxic double"
    spark.createDataFrame(whole, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, seen = docs, []
    for i, (_, stage) in enumerate(P.STAGES):
        kept = common.stage(stage(spark, kept, str(tmp_path)), f"{tmp_path}/stages", str(i))
        assert i == 4 or kept.columns == docs.columns
        seen.append(kept.collect())
    clean, exact, near, private, packed = seen
    ids = [r.doc_id for r in clean]
    bad = {i for i, _, t in labels if t}
    assert len(bad & set(ids)) <= 0.05 * len(bad) and len(set(range(240)) - bad - set(ids)) <= 2
    number = lambda r: 10**17 if r.doc_id is None else r.doc_id
    best = {}
    for r in clean:
        k = (r.text or "").lower()
        best[k] = max(best.get(k, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in exact) == sorted(best.values())
    classes = brute([(number(r), r.text) for r in exact])
    assert sorted(map(number, near)) == [d for d, c, _ in classes if d == c]
    before = {number(r): r.text for r in near}
    assert sorted(map(number, private)) == sorted(before)
    for r in private:
        was = before[number(r)]
        assert (r.text == was) == (not pii.detect(was or "")) and r.n_chars == (None if r.text is None else len(r.text))
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    length, places = {}, {}
    for r in packed:
        length[number(r)] = length.get(number(r), 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert length == {number(r): len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in private}
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
