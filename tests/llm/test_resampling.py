import hashlib
import math
import random
import re
import zlib

import pytest

from wayfold.llm import common, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    ws = WORD.findall((text or "").translate(LOWER))
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, longest=1, percent=10):
    k, s, t = 10_000, [0] * 10_000, [0] * 10_000
    bucket = lambda f: zlib.crc32(f.encode()) % k
    for rows, count in ((docs, s), (target, t)):
        for _, text in rows:
            for f in features(text, longest)[1]:
                count[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + k) / ((s[b] + 1) * (sum(t) + k)))) for b in range(k)]
    out = []
    for doc_id, text in docs:
        n, fs = features(text, longest)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def made(n=400):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "été", "x9", "gamma", "你好"]) + rng.choice(["", "s", "t"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "word-" * 30_000), (None, "null id " * 20), (5000, "again and " * 15), (5000, "again and " * 15), (5000, "again and " * 15)]


TARGET = [(0, "alpha alpha été"), (1, None), (2, "Gamma's x9")]


def frames(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "r") for i, t in rows], "doc_id long, text string, score int, rank int, row string")


@pytest.mark.parametrize("longest", [1, 2])
def test_equal_to_brute_force(spark, longest):
    rows = made()
    got = resampling.resample(spark, frames(spark, rows).repartition(7), spark.createDataFrame(TARGET, "item_id long, text string"), longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, TARGET, longest)


@pytest.mark.parametrize(("fan", "range_rows", "percent"), [(2, 20, 50), (3, 1000, 100), (64, 10, 7)])
def test_many_runs_and_ranges(spark, monkeypatch, fan, range_rows, percent):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 5)
    rows = made()
    scored = resampling.score(frames(spark, rows), resampling.gains(resampling.bucket_counts(frames(spark, rows)), resampling.bucket_counts(spark.createDataFrame(TARGET, "item_id long, text string"))))
    folder = common.work_folder(spark, "draw")
    from pyspark.sql import functions as F

    table = common.stage(scored.repartition(9).withColumn("row", F.monotonically_increasing_id()), folder, "scored")
    monkeypatch.setattr(resampling, "RUN_ROWS", 16)
    got = resampling.draw(table, folder, percent=percent, fan=fan, range_rows=range_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, TARGET, percent=percent)


def test_tournament_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        lists = [sorted((rng.randint(0, 9), rng.random()) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(resampling.merged(iter(x) for x in lists)) == sorted(sum(lists, []))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(spark, none, spark.createDataFrame(TARGET, "item_id long, text string")).collect() == []
    few = [(1, "a b"), (2, None)]
    assert sorted(tuple(r) for r in resampling.resample(spark, frames(spark, few), none).collect()) == brute(few, [])
