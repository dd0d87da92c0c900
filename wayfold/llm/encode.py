"""Token ids of whole texts with the tokenizers library.

A byte-level BPE encodes every pre-token by itself, and single spaces between
words always begin one, so words are encoded by the library once and looked up
when they come again. Any other kind of tokenizer encodes whole texts directly.
An added token's literal in a text is that token, as by the library's default.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Words that a worker remembers (about 70 MB); beyond it starts afresh.
REMEMBERED = 300_000
#: Letters before this are letters in every Unicode version in use.
AGREED = "\u0530"
#: Signs that end a word; they hold no letter, digit or space.
SIGNS = ".,;:!?%&*$#|()[]{}<>/+=~@^_-\"'"
#: The split of byte-level BPE with use_regex; a fixed value of that format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_open: dict[tuple[str, int], Encoder] = {}
common.forgets(_open.clear)


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        split = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not spec.get("post_processor") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"]) for x in spec.get("added_tokens", []))
        self.split = regex.compile(BYTE_LEVEL).findall if split else None
        self.wide = self.library.get_vocab_size() > 65536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.library.encode_special_tokens = split  # of the words; texts are cut at added tokens before
        self.added = {x["content"]: np.array([x["id"]], dtype=self.dtype).tobytes() for x in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.opens = np.zeros(self.library.get_vocab_size(), dtype=bool)  # tokens that begin with a space, as byte-level BPE spells it
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.spaced: dict[str, bytes] = {}  # of a space and the letters after it
        self.known: dict[str, bytes] = {}  # of other pre-tokens

    def _pretokens(self, groups: list[list[str]]) -> list[bytes]:
        """Ids of lists of pre-tokens."""
        known = self.known
        if len(known) > self.remembered // 8:
            known.clear()
        new: set[str] = set()
        for group in groups:
            new.update(group)
        fresh = list(new.difference(known))
        for w, e in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False) if fresh else (), strict=True):
            known[w] = np.array(e.ids, dtype=self.dtype).tobytes()
        return [b"".join([known[w] for w in group]) for group in groups]

    def _letters(self, words: Iterable[str]) -> None:
        """Learns letters after a space, each one pre-token; in a row of such a token with a space in front begins a word."""
        new, wide = list(words), self.dtype.itemsize
        for at in range(0, len(new), 20_000):
            group = new[at : at + 20_000]
            ids = np.concatenate([np.array(e.ids, dtype=self.dtype) for e in self.library.encode_batch_fast([" " + " ".join(group[i : i + 1000]) for i in range(0, len(group), 1000)], add_special_tokens=False)])
            data, begins = ids.tobytes(), (np.flatnonzero(self.opens[ids]) * wide).tolist()
            if len(begins) != len(group):
                raise ValueError("letters were split unlike one pre-token")
            self.spaced.update(zip(group, [data[i:j] for i, j in zip(begins, [*begins[1:], len(data)], strict=True)], strict=True))

    def _spaced(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of distinct words with a space before them; and which words keep a text from falling apart at its spaces."""
        spaced = self.spaced
        if len(spaced) > self.remembered:
            spaced.clear()
        out = [spaced.get(w) for w in words]
        letters, ended, other = [], [], []
        for i, (w, known) in enumerate(zip(words, out, strict=True)):
            if known is not None:
                continue
            if w.isalpha() and (w.isascii() or max(w) < AGREED):
                letters.append(i)
            elif (head := w.rstrip(SIGNS)).isalpha() and (head.isascii() or max(head) < AGREED):
                ended.append((i, head, w[len(head) :]))  # letters, then signs: two pre-tokens
            else:
                other.append(i)
        self._letters({words[i] for i in letters}.union(h for _, h, _ in ended).difference(spaced))
        for i in letters:
            out[i] = spaced[words[i]]
        last = list({c for *_, c in ended})
        tail = dict(zip(last, self._pretokens([self.split(c) for c in last]), strict=True))
        for i, head, c in ended:
            out[i] = spaced[head] + tail[c]
        uneven = np.zeros(len(words), dtype=bool)
        for i, data in zip(other, self._pretokens([self.split(" " + words[i]) for i in other]), strict=True):
            w, out[i] = words[i], data
            uneven[i] = not w or w[0].isspace() or w[-1].isspace()
        return out, uneven

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of the width of self.dtype."""
        if not texts:
            return []
        if not self.split:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        cut = {i: self.cut(t) for i, t in enumerate(texts) if any(a in t for a in self.added)}  # text, added token, text, ...
        if not cut:
            return self._plain(texts)
        between = iter(self._plain([p for i, t in enumerate(texts) for p in (cut[i][::2] if i in cut else (t,))]))
        return [b"".join(self.added[p] if j % 2 else next(between) for j, p in enumerate(cut.get(i, (t,)))) for i, t in enumerate(texts)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        # A pre-token begins at each space between characters that aren't space, whatever stands before it.
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begins = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        distinct, uneven = self._spaced(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy().copy()  # 32 bits, as are positions below: a batch is far from 2^31 tokens
        odd = np.concatenate([[0], np.cumsum(uneven[which])])
        whole = odd[begins[1:]] > odd[begins[:-1] + 1]  # the first word has no space before it
        which[begins[:-1]] = len(distinct)  # the first words come from elsewhere
        data = np.frombuffer(b"".join(distinct), dtype=self.dtype)
        size = np.array([*map(len, distinct), 0], dtype=np.int32) // self.dtype.itemsize
        sizes = size[which]
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = data[np.repeat((np.cumsum(size, dtype=np.int32) - size)[which] - (ends - sizes), sizes) + np.arange(total, dtype=np.int32)].tobytes()
        at = (np.concatenate([[0], ends])[begins] * self.dtype.itemsize).tolist()
        heads = self._pretokens([self.split(t if u else t.partition(" ")[0]) for t, u in zip(texts, whole.tolist(), strict=True)])
        return [h if u else h + ids[a:b] for h, u, a, b in zip(heads, whole.tolist(), at, at[1:], strict=False)]

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.dtype).astype("<u4")


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each path and memory in a worker process."""
    if (path, remembered) not in _open:
        _open[path, remembered] = Encoder(path, remembered)
    return _open[path, remembered]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
