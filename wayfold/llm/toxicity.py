"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each category's logistic model sees
the text's features and the probabilities of the categories before it. In training
these are out-of-fold predictions, so that a later model learns from inputs as
uncertain as those it will get.

Features are words and their beginnings of four to six letters (the most telling
ones by chi-square, logarithm of their count) and shares of kinds of characters.
The models are fitted on a bounded sample of labelled rows, those with the least
hash of doc_id; every row is scored over its whole text.

A null text is empty and is scored by its character shares alone. Rows without
a label count as unlabelled, and a doc_id labelled twice takes the larger label.
Without labels of both kinds a category has a constant probability. Repeated rows
are scored each. Other columns are not read by the query. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the models are fitted on at most.
SAMPLE_ROWS = 8_000
FEATURES, FOLDS, RIDGE = 1000, 5, 0.4
CATEGORIES = ("quality", "toxic")
_LETTERS = re.compile(r"[^\W\d_]+").findall

_kind = np.full(256, 5, dtype=np.int64)  # kinds of bytes
for _i, _cs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \n\t\r", b".,;:'\"-()")):
    _kind[list(_cs)] = _i
_kind[128:] = 6
KINDS = 7
DENSE = KINDS + 1


def _hashes(word: str) -> list[int]:
    h = xxhash.xxh32_intdigest
    return [h(word), *(h(f"^{word[:n]}") for n in (4, 5, 6) if len(word) >= n)]


def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between spaces as codes, and where each text's begin."""
    lists = pc.split_pattern(pc.utf8_lower(pa.array(texts, pa.large_string())), " ")
    return lists.values.dictionary_encode(), lists.offsets.to_numpy()


def dense(texts: list[str]) -> np.ndarray:
    data = [np.bincount(_kind[np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=KINDS) for t in texts]
    n = np.array(data, dtype=np.float64).reshape(-1, KINDS)
    total = n.sum(axis=1, keepdims=True)
    return np.hstack([n / np.maximum(total, 1), np.log1p(total) / 10])


@dataclass
class Linear:
    """A logistic model over chosen hashed features, dense ones and earlier probabilities."""

    chosen: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def predict(self, counts: np.ndarray, other: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(other), self.constant)
        x = np.hstack([counts, ((other - self.mean) / self.scale).astype(np.float32), np.ones((len(other), 1), dtype=np.float32)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


@dataclass
class Rows:
    """Hashed features of the training rows, in one array, with the row of each."""

    row: np.ndarray
    code: np.ndarray  # position in names
    count: np.ndarray
    names: np.ndarray
    n: int

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """row, code and count a million at a time: what is derived from them stays small on the driver."""
        for at in range(0, len(self.row), 1 << 20):
            s = slice(at, at + (1 << 20))
            yield self.row[s], self.code[s], self.count[s]

    def table(self, chosen: np.ndarray, use: np.ndarray, more: int = 0) -> np.ndarray:
        """log(1 + count) of chosen features in the rows of use, and room for further columns."""
        place = np.full(len(self.names), -1, dtype=np.int32)
        at = np.searchsorted(self.names, chosen)
        place[at] = np.arange(len(chosen))
        to = np.cumsum(use) - 1
        out = np.zeros((int(use.sum()), len(chosen) + more), dtype=np.float32)
        for row, code, count in self.parts():
            column = place[code]
            here = (column >= 0) & use[row]
            out[to[row[here]], column[here]] = np.log1p(count[here])
        return out


def choose(rows: Rows, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The features whose presence tells most of y by chi-square, of those in three rows at least."""
    df, pos = np.zeros(len(rows.names)), np.zeros(len(rows.names))
    for row, code, _ in rows.parts():
        here = use[row]
        df += np.bincount(code[here], minlength=len(rows.names))
        pos += np.bincount(code[here], weights=y[row[here]], minlength=len(rows.names))
    n, p = use.sum(), y[use].mean()
    expected = df * p
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - p) * (1 - df / n), 1e-9)
    chi[(df < 3) | (df == n)] = -1
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(rows.names[best[chi[best] > 3.84]])


def fit(rows: Rows, other: np.ndarray, y: np.ndarray, use: np.ndarray) -> Linear:
    """L2-regularised logistic regression by L-BFGS."""
    some = other[use] if use.any() else np.zeros((1, other.shape[1]))
    mean, scale = some.mean(axis=0), np.maximum(some.std(axis=0), 1e-3)
    none = np.zeros(0, dtype=rows.names.dtype)
    if len(set(y[use].tolist())) < 2:
        return Linear(none, np.zeros(0), mean, scale, float(y[use].mean()) if use.any() else 0.0)
    chosen = choose(rows, y, use)
    x = rows.table(chosen, use, other.shape[1] + 1)
    x[:, len(chosen) : -1] = ((other - mean) / scale)[use].astype(np.float32)
    x[:, -1] = 1
    target, ridge = y[use].astype(np.float32), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        value = float(np.sum(np.logaddexp(0, z) - target * z)) + 0.5 * float(ridge @ (w * w))
        return value, (x.T @ (p - target)).astype(np.float64) + ridge * w

    w = np.zeros(x.shape[1])
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(80):
        q, alphas = grad.copy(), []
        for s, d, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * d
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, d, rho), a in zip(past, reversed(alphas), strict=True):
            q += (a - rho * (d @ q)) * s
        step = 1.0
        while step > 1e-6:
            new = w - step * q
            v, g = loss(new)
            if v <= value - 1e-4 * step * float(grad @ q):
                break
            step /= 2
        else:
            break
        s, d = new - w, g - grad
        if s @ d > 1e-12:
            past = [*past[-7:], (s, d, 1 / (s @ d))]
        small = value - v < 1e-6 * max(1.0, abs(value))
        w, value, grad = new, v, g
        if small:
            break
    return Linear(chosen, w, mean, scale)


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    place: dict[int, int] = field(default_factory=dict)  # a hashed feature's column among all chosen ones

    def __post_init__(self) -> None:
        every = np.unique(np.concatenate([m.chosen for m in self.models])) if self.models else np.zeros(0, dtype=np.uint32)
        self.place = {int(h): i for i, h in enumerate(every)}
        self.columns = [np.searchsorted(every, m.chosen) for m in self.models]

    def predict(self, texts: list[str]) -> np.ndarray:
        """A probability for each text and category."""
        if not texts:
            return np.zeros((0, len(self.models)))
        coded, begins = _words(texts)
        place, own, hit = self.place, [], []
        for i, word in enumerate(coded.dictionary.to_pylist()):
            found = [place[h] for w in _LETTERS(word) for h in _hashes(w) if h in place]
            if found:
                hit.append(i)
                own.append(found)
        counts = np.zeros((len(texts), len(place)), dtype=np.float32)
        if hit:
            which = coded.indices.to_numpy()
            to = np.full(len(coded.dictionary), -1)
            to[hit] = np.arange(len(hit))
            at = np.flatnonzero(to[which] >= 0)
            doc = np.searchsorted(begins, at, side="right") - 1
            k = to[which[at]]
            many = np.array([len(x) for x in own])
            flat = np.concatenate([np.array(x) for x in own])
            first = np.cumsum(many) - many
            n = many[k]
            ends = np.cumsum(n)
            column = flat[np.repeat(first[k] - (ends - n), n) + np.arange(int(ends[-1]))]
            np.add.at(counts, (np.repeat(doc, n), column), 1)
            counts = np.log1p(counts)
        other = dense(texts)
        for m, c in zip(self.models, self.columns, strict=True):
            other = np.hstack([other, m.predict(counts[:, c], other)[:, None]])
        return other[:, DENSE:]


def train(rows: Rows, other: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """labels: a column for each category, in the chain's order."""
    models = []
    for i in range(len(categories)):
        y = labels[:, i]
        models.append(fit(rows, other, y, np.ones(rows.n, dtype=bool)))
        if i + 1 < len(categories):
            out = np.zeros(rows.n)
            for f in range(FOLDS):
                held = fold == f
                if held.any():
                    m = fit(rows, other, y, ~held) if (~held).any() else models[-1]
                    out[held] = m.predict(rows.table(m.chosen, held), other[held])
            other = np.hstack([other, out[:, None]])
    return Chain(categories, models)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and counts of each text."""
    coded, begins = _words(texts)
    own = [[h for w in _LETTERS(word) for h in _hashes(w)] for word in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy()
    return [np.unique(np.array([h for k in which[a:b].tolist() for h in own[k]], dtype=np.uint32), return_counts=True) for a, b in zip(begins, begins[1:], strict=False)]


def sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], most: int) -> list:
    """Features of the labelled rows with the least hash of doc_id; at most most rows come to the driver. More than 65,535 mentions in a text count as so many."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"y{i}") for i, c in enumerate(categories)))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = features(common.strings(b.column(1)))
                other = dense(common.strings(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array([h.astype("<u4").tobytes() for h, _ in found], pa.binary()), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for _, c in found], pa.binary()), pa.array(other.tolist(), pa.list_(pa.float64()))], names)

    ys = [f"y{i}" for i in range(len(categories))]
    names = ["doc_id", *ys, "hashes", "counts", "other"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *ys)
    found = texts.mapInArrow(run, f"doc_id long, {', '.join(f'{y} int' for y in ys)}, hashes binary, counts binary, other array<double>")
    # repeated rows could exceed the bound
    return sorted(found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect(), key=lambda r: (r.doc_id, r.hashes))


def learn(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, most: int = SAMPLE_ROWS) -> Chain:
    got = sample(docs, labels, categories, most)
    hashes = [np.frombuffer(r.hashes, dtype="<u4") for r in got]
    names, many = np.unique(np.concatenate([*hashes, np.zeros(0, dtype="<u4")]), return_counts=True)
    names = names[many >= 3]
    del many
    # row by row, so that only features of three rows or more take place
    code, count = [], []
    for h, r in zip(hashes, got, strict=True):
        at = np.minimum(np.searchsorted(names, h), max(len(names) - 1, 0)).astype(np.int32)
        use = names[at] == h if len(names) else np.zeros(len(h), dtype=bool)
        code.append(at[use])
        count.append(np.frombuffer(r.counts, dtype="<u2")[use])
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) for x in code])
    rows = Rows(row, np.concatenate([*code, np.zeros(0, dtype=np.int32)]), np.concatenate([*count, np.zeros(0, dtype="<u2")]), names, len(got))
    del hashes, code, count, row
    other = np.array([r.other for r in got], dtype=np.float64).reshape(len(got), DENSE)
    ys = np.array([[r[f"y{i}"] for i in range(len(categories))] for r in got], dtype=np.float64).reshape(len(got), len(categories))
    fold = np.array([xxhash.xxh32_intdigest(str(r.doc_id)) % FOLDS for r in got])
    del got
    common.trim()
    chain = train(rows, other, ys, fold, categories)
    del rows
    common.trim()
    return chain


def score(spark: SparkSession, docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """docs with a probability p_<category> for each category, and <last category>_found."""
    common.small_batches(spark, 2000)
    sent = spark.sparkContext.broadcast(chain)
    new = [f"p_{c}" for c in chain.categories]
    flag = f"{chain.categories[-1]}_found"
    docs = docs.drop(*new, flag)
    at = docs.columns.index("text")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sent.value.predict(common.strings(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i]) for i in range(len(new))), pa.array(p[:, -1] >= threshold)], [*b.schema.names, *new, flag])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{c}` double" for c in new), f"`{flag}` boolean"])
    return docs.mapInArrow(run, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    common.small_batches(spark, 2000)
    return score(spark, docs, learn(docs, labels))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.parquet(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(spark, docs, common.parquet(spark, sf_dir, "labels")).drop("text")
