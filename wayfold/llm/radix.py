"""Byte radix tries with a leaf of counters, that merge, are cut at prefixes and pass through bytes.

A node is [label, children by first byte, number of its leaf]. The counters of all leaves are
rows of arrays, keyed by leaf and counter; they are summed when they have become many, or are
read. Order is that of bytes, which for UTF-8 is that of code points.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np

_HEAD = struct.Struct("<II")  # leaves, counters
STEM = 4
#: Rows of counters that a trie holds before it sums them.
SUMMED = 1_000_000


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7 >> 3)


def changes(keys: np.ndarray) -> np.ndarray:
    """Places in a sorted array whose key isn't that of the place before."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = changes(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Leaves(NamedTuple):
    """Terms in order, the bytes each shares with the one before, its number of counters; then the counters of all and their counts."""

    terms: list[bytes]
    shares: np.ndarray
    sizes: np.ndarray
    counters: np.ndarray
    counts: np.ndarray

    def each(self) -> Iterator[tuple[bytes, dict[int, int]]]:
        pairs = zip(self.counters.tolist(), self.counts.tolist(), strict=True)
        for term, size in zip(self.terms, self.sizes.tolist(), strict=True):
            yield term, dict(next(pairs) for _ in range(size))


class Trie:
    """Its first STEM bytes are one step: a table of subtries, so that a walk down is short."""

    def __init__(self) -> None:
        self.stems: dict[bytes, list] = {}
        self.leaves = 0
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, SUMMED

    def leaf(self, term: bytes, path: list[tuple[bytes, list]]) -> int:
        """The number of a term's leaf, made where there is none: walks down the labels, splitting the one that differs.

        The walk begins at the lowest node of the path that lies above the term; the path becomes the term's."""
        stem = term[:STEM]
        if path and path[0][0] == stem:
            while not term.startswith(path[-1][0]):
                path.pop()
        else:
            node = self.stems.get(stem)
            if node is None:
                node = self.stems[stem] = [b"", None, None]
            path[:] = [(stem, node)]
        above, node = path[-1]
        at, end = len(above), len(term)
        while at < end:
            children, first = node[1], term[at]
            child = children.get(first) if children else None
            if child is None:
                child = [term[at:], None, self.leaves]
                if children:
                    children[first] = child
                else:
                    node[1] = {first: child}
                self.leaves += 1
                path.append((term, child))
                return child[2]
            label = child[0]
            if term.startswith(label, at):
                at += len(label)
                node = child
            else:
                k = shared(label, term[at : at + len(label)])
                node = children[first] = [label[:k], {label[k]: child}, None]
                child[0] = label[k:]
                at += k
            path.append((term[:at], node))
        if node[2] is None:
            node[2] = self.leaves
            self.leaves += 1
        return node[2]

    def insert(self, terms: Iterable[bytes], sizes: np.ndarray, counters: np.ndarray, counts: np.ndarray) -> None:
        """Adds terms, each with so many of the counters. Terms in order share their walks down."""
        leaf, path = self.leaf, []
        numbers = np.array([leaf(term, path) for term in terms], dtype=np.int64)
        self.rows.append((np.repeat(numbers, sizes) << 32 | counters.astype(np.int64), counts.astype(np.int64)))
        self.held += len(counts)
        if self.held > self.most:
            self._sum()
            self.most = max(SUMMED, 2 * self.held)

    def _sum(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) != 1:
            keys, counts = ([x[i] for x in self.rows] or [np.zeros(0, dtype=np.int64)] for i in (0, 1))
            self.rows = [summed(np.concatenate(keys), np.concatenate(counts))]
            self.held = len(self.rows[0][0])
        return self.rows[0]

    def add(self, term: bytes, counter: int, n: int) -> None:
        self.insert([term], np.ones(1, dtype=np.int64), np.array([counter]), np.array([n]))

    def traverse(self) -> Leaves:
        """Terms and their counters in the order of bytes."""
        terms: list[bytes] = []
        numbers: list[int] = []
        shares: list[int] = []
        share, term = 0, b""  # with the term before
        for stem in sorted(self.stems):
            share = min(share, shared(term[:STEM], stem))
            stack = [(stem, self.stems[stem])]
            while stack:
                above, node = stack.pop()
                if len(above) < share:
                    share = len(above)
                below = above + node[0]
                if node[2] is not None:
                    term = below
                    terms.append(term)
                    numbers.append(node[2])
                    shares.append(share)
                    share = len(term)
                children = node[1]
                if children:
                    stack.extend((below, children[b]) for b in sorted(children, reverse=True))
        rank = np.empty(len(terms), dtype=np.int64)
        rank[numbers] = np.arange(len(terms))
        keys, counts = self._sum()
        keys, counts = summed(rank[keys >> 32] << 32 | keys & 0xFFFFFFFF, counts)
        return Leaves(terms, np.array(shares, dtype=np.int64), np.bincount(keys >> 32, minlength=len(terms)), keys & 0xFFFFFFFF, counts)

    def items(self) -> Iterator[tuple[bytes, dict[int, int]]]:
        return self.traverse().each()

    def merge(self, data: bytes) -> None:
        """Adds a trie that pack() wrote: the counters of its leaves are summed."""
        terms, _, sizes, counters, counts = unpack(data)
        self.insert(terms, sizes, counters, counts)


def leaves_of(items: Iterable[tuple[bytes, dict[int, int]]]) -> Leaves:
    """Of terms in order with their counters."""
    items = list(items)
    terms = [term for term, _ in items]
    shares = [shared(a, b) for a, b in pairwise([b"", *terms])]
    ints = lambda xs: np.array(xs, dtype=np.int64)
    return Leaves(terms, ints(shares), ints([len(x) for _, x in items]), ints([c for _, x in items for c in x]), ints([n for _, x in items for n in x.values()]))


def pack(leaves: Leaves | list[tuple[bytes, dict[int, int]]]) -> bytes:
    """Leaves in order, each without what it shares with the one before."""
    terms, shares, sizes, counters, counts = leaves if isinstance(leaves, Leaves) else leaves_of(leaves)
    shares = shares.astype("<u4")
    shares[:1] = 0
    labels = [term[k:] for term, k in zip(terms, shares.tolist(), strict=True)]
    lengths = np.array([len(x) for x in labels], dtype="<u4")
    numbers = (x.tobytes() for x in (shares, lengths, sizes.astype("<u4"), counters.astype("<u4"), counts.astype("<i8")))
    return b"".join([_HEAD.pack(len(terms), len(counts)), *numbers, *labels])


def unpack(data: bytes) -> Leaves:
    n, m = _HEAD.unpack_from(data)
    shares, lengths, sizes = np.frombuffer(data, "<u4", 3 * n, _HEAD.size).reshape(3, n)
    at = _HEAD.size + 12 * n
    counters, counts = np.frombuffer(data, "<u4", m, at), np.frombuffer(data, "<i8", m, at + 4 * m)
    at += 12 * m
    before, terms = b"", []
    for k, more in zip(shares.tolist(), lengths.tolist(), strict=True):
        before = before[:k] + data[at : at + more]
        at += more
        terms.append(before)
    return Leaves(terms, shares, sizes, counters, counts)


def pieces(leaves: Leaves | Iterable[tuple[bytes, dict[int, int]]], depth: int) -> Iterator[tuple[bytes, Leaves | list[tuple[bytes, dict[int, int]]]]]:
    """Subtrees below prefixes of up to depth bytes, in order; a shorter term is a piece of its own. Given leaves, gives leaves; given items, items."""
    items = None if isinstance(leaves, Leaves) else list(leaves)
    terms, shares, sizes, counters, counts = leaves if items is None else leaves_of(items)
    below = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()
    cuts = np.flatnonzero(shares < depth)
    for a, b in pairwise([*cuts.tolist(), len(terms)]):
        mine = slice(below[a], below[b])
        yield terms[a][:depth], Leaves(terms[a:b], shares[a:b], sizes[a:b], counters[mine], counts[mine]) if items is None else items[a:b]
