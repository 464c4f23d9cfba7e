"""Test items that leak into training texts, found with a generalised suffix automaton.

The automaton is built over the items' words (runs of letters and digits, without regard to case) and
knows every run of words that any item holds. A training text streams through it word by word; the
state reached and the length matched give, at each word, the longest run that ends there and the
items that hold it. The items are a stated query set: they are cut into blocks of at most BLOCK_WORDS
words, one automaton a block is broadcast, and every text, read once, meets every block.

Defined results: null, empty and blank texts or items leak nothing; an item shorter than the least
length cannot leak; equal items all leak; repeated rows of texts give repeated rows of spans, and one
pair in `leaks`; other columns are ignored by `leaks` and kept by `without_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: The consecutive words that make a leak, and the words of items in one automaton.
LEAST_WORDS, BLOCK_WORDS = 10, 400_000


class Automaton:
    """Suffix automaton of many word sequences; each state has the items that hold its runs."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_WORDS):
        self.least = least
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        sequences = []
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in WORD.findall((text or "").lower())]
            if len(words) >= least:
                sequences.append((item, words))
        for _, words in sequences:
            at = 0
            for w in words:
                at = self._extend(at, w)
        holders: list[set[int]] = [set() for _ in self.link]
        for item, words in sequences:
            at = 0
            for w in words:
                at = self.next[at][w]
                up = at
                # nobody asks who holds a run shorter than the least
                while up > 0 and self.size[up] >= least and item not in holders[up]:
                    holders[up].add(item)
                    up = self.link[up]
        self.holders = [tuple(sorted(h)) for h in holders]
        # of each state, the one that holds the run of the least length at its end
        self.short = list(range(len(self.link)))
        for s in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            if self.size[self.link[s]] >= least:
                self.short[s] = self.short[self.link[s]]

    def _new(self, size: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.size.append(size)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return new

    def items_in(self, text: str | None) -> set[int]:
        """Items of which the text holds at least the least number of consecutive words."""
        found: set[int] = set()
        for _, state, _ in self._hits(WORD.findall((text or "").lower())):
            found.update(self.holders[self.short[state]])
        return found

    def _hits(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position of a word, state, matched length) wherever the length reaches the least."""
        ids, nxt, link, size, least = self.ids.get, self.next, self.link, self.size, self.least
        state = length = 0
        for i, word in enumerate(words):
            w = ids(word)
            if w is None:
                state = length = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while to is None and state > 0:
                    state = link[state]
                    to = nxt[state].get(w)
                length = size[state] if to is not None else 0
                state = to or 0
                length += to is not None
            else:
                state = to
                length += 1
            if length >= least:
                yield i, state, length

    def spans(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, first word, words, first character, end character) of each longest run held by an item."""
        marks = list(WORD.finditer(text or ""))
        ends: dict[tuple[int, int], int] = {}  # (item, first word) -> last word
        for i, state, length in self._hits([m.group().lower() for m in marks]):
            seen: set[int] = set()
            while state > 0 and min(length, self.size[state]) >= self.least:
                length = min(length, self.size[state])
                for item in self.holders[state]:
                    if item not in seen:
                        seen.add(item)
                        ends[item, i - length + 1] = i
                state = self.link[state]
        # a run that ends later from an earlier word covers those that it contains
        out, reach = [], {}
        for (item, first), last in sorted(ends.items(), key=lambda x: (x[0][1], -x[1])):
            if reach.get(item, -1) < last:
                reach[item] = last
                out.append((item, first, last - first + 1, marks[first].start(), marks[last].end()))
        return out


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of at most so many words (one longer item is a block of its own)."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(WORD.findall(row[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def automata(sc, items: DataFrame, least: int, block_words: int) -> list:
    """One broadcast automaton a block; the driver holds one block at a time."""
    return [sc.broadcast(Automaton(block, least)) for block in blocks(items, block_words=block_words)]


def _by_block(documents: DataFrame, items: DataFrame, key: str, text: str, least: int, find, names: list[str], schema: str, block_words: int) -> DataFrame:
    """The documents are read once, whatever the number of blocks."""
    shared = automata(documents.sparkSession.sparkContext, items, least, block_words)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [(k, *x) for a in shared for k, t in zip(keys, texts, strict=True) for x in find(a.value, t)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            types = [b.schema.field(0).type] + [pa.int64()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return documents.select(key, text).mapInArrow(batches, schema)


def leak_spans(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item_id, first_word, n_words, first_char, end_char) of each longest run shared with an item."""
    kind = documents.schema[key].dataType.simpleString()
    names = [key, "item_id", "first_word", "n_words", "first_char", "end_char"]
    return _by_block(
        documents, items, key, text, least, Automaton.spans, names,
        f"`{key}` {kind}, item_id bigint, first_word bigint, n_words bigint, first_char bigint, end_char bigint", block_words,
    )


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Distinct (key, item_id) with at least so many consecutive words in common. No shuffle unless a
    key is repeated: the rows of one text come from one task, so only the few pairs are made distinct."""
    kind = documents.schema[key].dataType.simpleString()

    def find(automaton: Automaton, t: str | None) -> list[tuple[int]]:
        return [(i,) for i in sorted(automaton.items_in(t))]

    return _by_block(documents, items, key, text, least, find, [key, "item_id"], f"`{key}` {kind}, item_id bigint", block_words).distinct()


def without_leaks(documents: DataFrame, items: DataFrame, text: str = "text", least: int = LEAST_WORDS, coverage: float = 0.5) -> DataFrame:
    """documents with the leaked runs cut out of the text, `leaked_words` and `leak_dropped`.

    A text of whose words more than the share `coverage` leaks is to be dropped whole: leak_dropped is
    true and the text is null. Texts without a leak, null ones included, are unchanged.
    """
    sc = documents.sparkSession.sparkContext
    shared = automata(sc, items, least, BLOCK_WORDS)
    documents = documents.drop("leaked_words", "leak_dropped")
    at = documents.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kept, counts, dropped = [], [], []
            for t in b.column(at).to_pylist():
                cuts = sorted({(f, e) for a in shared for _, _, _, f, e in a.value.spans(t)})
                merged: list[list[int]] = []
                for f, e in cuts:
                    if merged and f <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([f, e])
                n = sum(len(WORD.findall(t[f:e])) for f, e in merged)
                drop = n > coverage * len(WORD.findall(t)) if n else False
                ends = [0, *(e for _, e in merged)]
                starts = [*(f for f, _ in merged), len(t or "")]
                kept.append(None if drop or t is None else "".join(t[e:f] for e, f in zip(ends, starts, strict=True)) if merged else t)
                counts.append(n)
                dropped.append(bool(drop))
            columns = [pa.array(kept, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.bool_())], [*b.schema.names, "leaked_words", "leak_dropped"])

    schema = T.StructType(list(documents.schema)).add("leaked_words", "long").add("leak_dropped", "boolean")
    return documents.mapInArrow(batches, schema)
