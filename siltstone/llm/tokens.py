"""Byte-level BPE of a whole corpus by prefix-sharing traversal of the trie of distinct words.

Of any prefix of a word, BPE's encoding is the encoding of a shorter prefix followed by one token, and
that token is the only one of the prefix's suffixes that is a token and stands next to the shorter
prefix's last token without a merge across their border. So one number a trie node, its last token,
holds all encodings. The distinct words of a batch are walked in sorted order, which is depth-first
through their trie: what two neighbours share is computed once.

Defined results: null and empty texts give an empty list; blank and very long texts are encoded whole;
text that looks like a special token is ordinary text; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the public pattern that cuts text into words for byte_bpe_50k.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and judged pairs kept between batches of one task, and bytes of text encoded at a time.
KEPT_WORDS, KEPT_PAIRS, BLOCK = 300_000, 500_000, 8_000_000


class Vocabulary:
    """Ranks of a .tiktoken file, with the two parts that each token was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(word) > 1:
                pieces = self._merge(word, rank)
                if len(pieces) == 2:
                    pair = ranks[pieces[0]], ranks[pieces[1]]
                    self.parts[rank] = pair
                    self.merged[pair] = rank
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Vocabulary:
        lines = Path(folder, f"{name}.tiktoken").read_bytes().split(b"\n")
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def _merge(self, word: bytes, below: int) -> list[bytes]:
        """Plain BPE with the merges of lower rank than the given one."""
        pieces = [word[i : i + 1] for i in range(len(word))]
        while len(pieces) > 2:
            best = min(((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))), default=(below, 0))
            if best[0] >= below:
                break
            pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
        return pieces

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that ever stood at the token's right (1) or left (0) edge, each with the rank of
        the merge that took it up; nothing takes up the token itself."""
        edges = self.right_edge if side else self.left_edge
        if token not in edges:
            chain_, until = [], 1 << 60
            t = token
            while True:
                chain_.append((t, until))
                if t not in self.parts:
                    break
                until, t = t, self.parts[t][side]
            edges[token] = chain_
        return edges[token]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side: no merge across their border comes before the merges
        that take up its two pieces. Of equal merges the left one comes first."""
        known = self.fits.get((a, b))
        if known is None:
            merged = self.merged
            known = not any((r := merged.get((x, y))) is not None and r < until_x and r <= until_y for x, until_x in self._edge(a, 1) for y, until_y in self._edge(b, 0))
            self.fits[a, b] = known
        return known

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of the words, which are distinct and in ascending order."""
        ranks, longest, adjacent = self.ranks, self.longest, self.adjacent
        last, size = [0], [0]  # of each prefix on the path: its last token and that token's length
        before = b""
        for word in words:
            shared = _shared(before, word)
            del last[shared + 1 :], size[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                for start in range(max(0, n - longest), n):
                    t = ranks.get(word[start:n])
                    if t is not None and (start == 0 or adjacent(last[start], t)):
                        last.append(t)
                        size.append(n - start)
                        break
            ids, n = [], len(word)
            while n:
                ids.append(last[n])
                n -= size[n]
            ids.reverse()
            yield ids
            before = word


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Encoder:
    """Encodes texts in blocks; keeps the words it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = WORDS):
        self.vocabulary, self.find, self.ids = vocabulary, regex.compile(pattern).findall, {}

    def learn(self, words: set[str]) -> None:
        if len(self.vocabulary.fits) > KEPT_PAIRS:
            self.vocabulary.fits.clear()
        new = sorted((w.encode("utf-8", "replace"), w) for w in words if w not in self.ids)
        keys = [k for i, (k, _) in enumerate(new) if not i or k != new[i - 1][0]]
        by_key = dict(zip(keys, self.vocabulary.encode_sorted(keys), strict=True))
        self.ids.update((w, by_key[k]) for k, w in new)

    def __call__(self, texts: list[str | None]) -> pa.ListArray:
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
        self.learn(set(chain.from_iterable(cut)))
        get = self.ids.__getitem__
        out = [list(chain.from_iterable(map(get, words))) for words in cut]
        offsets = np.zeros(len(out) + 1, np.int32)
        np.cumsum([len(x) for x in out], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(out), np.int32, offsets[-1])))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) of each row. The vocabulary, read on the driver, is broadcast: its size is the
    tokenizer's. No shuffle: each task keeps its own words, at most KEPT_WORDS between batches."""
    sc = df.sparkSession.sparkContext
    ranks = sc.broadcast(Vocabulary.load(tokenizer, folder))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in it:
            texts, first = b.column(1), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while first < len(texts):
                done = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + BLOCK, "right")))
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder(part.column(1).to_pylist())], [key, "ids"])
                first = last

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(batches, f"`{key}` {kind}, ids array<int>")
