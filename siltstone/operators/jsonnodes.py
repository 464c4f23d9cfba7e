"""Nested JSON texts turned into flat node and value tables that keep the link to the parent.

A batch's texts are handled as one Arrow buffer. Structural characters are found for the whole buffer
at once, each nesting level is cut into child arrays by parent indices (a search among the level
above), and row keys and paths reach the children by vectorised take. No text is parsed on its own.

Defined results: null or empty lists and null texts give no rows; a text that is not one standard
JSON value (RFC 8259: no NaN, comments, trailing commas, bare words, control characters in strings or
second value) gives no rows; a repeated key or path within one row's texts gives one node; rows that
occur twice give their nodes twice; texts of any length and depth are taken whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

OBJ, ARR, END_OBJ, END_ARR, COMMA, COLON, STRING, SCALAR, NONE = range(9)
STRUCT_CODE = np.full(256, 255, np.uint8)
for _char, _code in ((b"{", OBJ), (b"[", ARR), (b"}", END_OBJ), (b"]", END_ARR), (b",", COMMA), (b":", COLON)):
    STRUCT_CODE[_char[0]] = _code
SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))
ESCAPES = np.isin(np.arange(256), list(b'"\\/bfnrtu'))
SCALAR_FORM = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
#: Bytes of text handled at a time; texts are never cut, one longer than this is handled alone.
BLOCK = 16 << 20


class Tokens:
    """Tokens of the valid texts of one block, in order, with the container that holds each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(data)
        at_start = np.zeros(n + 1, bool)
        at_start[starts] = True
        escaped = np.zeros(n + 6, bool)
        slashes = np.flatnonzero(data == 92)
        if len(slashes):
            fresh = np.r_[True, (np.diff(slashes) != 1)] | at_start[slashes]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0))
            odd = (np.arange(len(slashes)) - first) % 2 == 0
            escaped[slashes[odd] + 1] = True
            escaped[starts] = False
        quote = (data == 34) & ~escaped[:n]
        count = np.r_[0, np.cumsum(quote)]
        # whether the byte is inside a string, its opening quote included: an odd count since the text began
        base = np.repeat(count[starts], ends - starts)
        inside = ((count[1:] - base) & 1).astype(bool)
        bad = np.zeros(len(starts), bool)
        bad |= ((count[ends] - count[starts]) & 1).astype(bool)

        def blame(where: np.ndarray) -> None:
            bad[np.searchsorted(ends, where, "right")] = True

        blame(np.flatnonzero((data < 32) & inside))
        if len(slashes):
            blame(slashes[~inside[slashes]])
            at = np.flatnonzero(escaped[:n] & inside)
            blame(at[~ESCAPES[data[at]]])
            padded = np.r_[data, np.zeros(6, np.uint8)]
            four = at[data[at] == 117]
            blame(four[~(HEX[padded[four + 1]] & HEX[padded[four + 2]] & HEX[padded[four + 3]] & HEX[padded[four + 4]])])
        closing = quote & ~inside
        outside = ~inside & ~closing
        code = np.where(outside, STRUCT_CODE[data], 255)
        code[quote & inside] = STRING
        other = outside & (code == 255) & ~SPACE[data]
        begins = other & ~np.r_[False, other[:-1]] | other & at_start[:n]
        code[begins] = SCALAR
        pos = np.flatnonzero(code != 255)
        kind = code[pos]
        # the end of each string and scalar
        stop = pos + 1
        closers = np.flatnonzero(closing)
        if len(closers):
            s = kind == STRING
            stop[s] = closers[np.minimum(np.searchsorted(closers, pos[s]), len(closers) - 1)] + 1
        v = kind == SCALAR
        if v.any():
            last = np.flatnonzero(other & ~(np.r_[other[1:], False] & ~np.r_[at_start[1:n], True]))
            stop[v] = last + 1
            sizes = stop[v] - pos[v]
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[other])]).dictionary_encode()
            good = np.array([SCALAR_FORM.fullmatch(w) is not None for w in words.dictionary.to_pylist()])
            blame(pos[v][~good[words.indices.to_numpy()]])
        doc = np.searchsorted(ends, pos, "right")
        keep = ~bad[doc]
        pos, kind, stop, doc = pos[keep], kind[keep], stop[keep], doc[keep]
        bad |= np.bincount(doc, minlength=len(starts)) == 0

        step = (kind <= ARR).astype(np.int64) - ((kind == END_OBJ) | (kind == END_ARR))
        after = np.cumsum(step)
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        before_doc = np.zeros(len(starts), np.int64)
        before_doc[doc[edge]] = after[edge] - step[edge]
        depth = after - before_doc[doc]
        bad[doc[depth < 0]] = True
        if len(edge):
            bad[doc[edge][depth[np.r_[edge[1:], len(doc)] - 1] != 0]] = True
        # a container's own level is the one it stands on; its end has the same level
        level = depth - (kind <= ARR)
        keep = ~bad[doc]
        pos, kind, stop, doc, level = pos[keep], kind[keep], stop[keep], doc[keep], level[keep]

        # the container around each token, found level by level among the opens of the level above
        m = len(pos)
        parent, ordinal = np.full(m, -1, np.int64), np.zeros(m, np.int64)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(level.max() + 2)) if m else np.zeros(1, np.int64)
        own_open = np.full(m, -1, np.int64)
        opens = np.zeros(0, np.int64)
        for k in range(len(cuts) - 1):
            here = order[cuts[k] : cuts[k + 1]]
            if k:
                up = opens[np.searchsorted(opens, here, "right") - 1]
                parent[here] = up
                commas = np.cumsum(kind[here] == COMMA)
                head = np.searchsorted(here, opens, "right")
                before = np.r_[0, commas][head]
                ordinal[here] = commas - before[np.searchsorted(opens, up)]
            opens_here = here[kind[here] <= ARR]
            ends_here = here[(kind[here] == END_OBJ) | (kind[here] == END_ARR)]
            if len(ends_here):
                own_open[ends_here] = opens_here[np.searchsorted(opens_here, ends_here) - 1]
            opens = opens_here
        before = np.r_[NONE, kind[:-1]] if m else kind
        before = np.where(np.r_[True, doc[1:] != doc[:-1]], NONE, before) if m else before
        around = np.where(parent >= 0, kind[np.maximum(parent, 0)], NONE)
        is_key = (kind == STRING) & (around == OBJ) & ((before == OBJ) | (before == COMMA))
        was_key = np.r_[False, is_key[:-1]] if m else is_key
        value_before = ((before == STRING) & ~was_key) | (before == SCALAR) | (before == END_OBJ) | (before == END_ARR)
        starts_value = (kind <= ARR) | (kind == SCALAR) | (kind == STRING)
        ok = np.zeros(m, bool)
        ok |= starts_value & (around == NONE) & (before == NONE)
        ok |= starts_value & (around == ARR) & ((before == ARR) | (before == COMMA))
        ok |= starts_value & (around == OBJ) & (before == COLON)
        ok |= is_key
        ok |= (kind == COLON) & (around == OBJ) & (before == STRING) & was_key
        ok |= (kind == COMMA) & (around != NONE) & value_before
        ended = np.where(own_open >= 0, kind[np.maximum(own_open, 0)], NONE)
        ok |= (kind == END_OBJ) & (ended == OBJ) & (value_before | (before == OBJ))
        ok |= (kind == END_ARR) & (ended == ARR) & (value_before | (before == ARR))
        bad[doc[~ok]] = True
        self.data, self.bad = data, bad
        self.pos, self.stop, self.kind, self.doc, self.level, self.parent, self.ordinal, self.is_key, self.around = pos, stop, kind, doc, level, parent, ordinal, is_key, around

    def text(self, tokens: np.ndarray, strip: int) -> pa.Array:
        """The bytes of the tokens, without strip bytes at either end, as strings; escapes are undone."""
        starts, ends = self.pos[tokens] + strip, self.stop[tokens] - strip
        sizes = ends - starts
        offsets = np.r_[0, np.cumsum(sizes)]
        index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        taken = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[index]))])
        if strip and (self.data[index] == 92).any():
            rows = taken.to_pylist()
            undo = lambda s: json.loads(b'"' + s + b'"').encode("utf-8", "replace")
            taken = pa.array([undo(s) if b"\\" in s else s for s in rows], pa.large_binary())
        return taken.cast(pa.string())


def _paths(t: Tokens, element: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Containers and other values of the valid texts, level by level: tokens, own path, path of the
    nearest object around, and whether the token is a container."""
    value = (t.kind <= ARR) | (t.kind == SCALAR) | (t.kind == STRING) & ~t.is_key
    value &= ~t.bad[t.doc]
    tokens, own, near = [], [], []
    slot = np.zeros(len(t.pos), np.int64)
    up_path = up_near = None
    order = np.flatnonzero(value)
    order = order[np.argsort(t.level[order], kind="stable")]
    cuts = np.r_[np.flatnonzero(np.diff(t.level[order], prepend=-1)), len(order)]
    for k in range(len(cuts) - 1):
        here = order[cuts[k] : cuts[k + 1]]
        if k == 0:
            path = pa.array(element[t.doc[here]]).cast(pa.string())
            around = pa.array([""] * len(here), pa.string())
        else:
            in_obj = t.around[here] == OBJ
            label = np.empty(len(here), np.int64)
            label[in_obj] = np.arange(in_obj.sum())
            label[~in_obj] = np.arange((~in_obj).sum()) + in_obj.sum()
            keys = t.text(here[in_obj] - 2, 1)
            steps = pa.array(t.ordinal[here[~in_obj]]).cast(pa.string())
            labels = pa.concat_arrays([keys, steps]).take(pa.array(label))
            above = pa.array(slot[t.parent[here]])
            path = pc.binary_join_element_wise(up_path.take(above), labels, "/")
            around = up_near.take(above)
        slot[here] = np.arange(len(here))
        up_path = path
        up_near = pc.if_else(pa.array(t.kind[here] == OBJ), path, around)
        tokens.append(here)
        own.append(path)
        near.append(around)
    if not tokens:
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), pa.array([], pa.string()), none.astype(bool)
    tokens = np.concatenate(tokens)
    return tokens, pa.concat_arrays(own), pa.concat_arrays(near), t.kind[tokens] <= ARR


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, Tokens]]:
    """(row ids, element positions, tokens) of at most BLOCK bytes of text at a time."""
    ids, lists = batch.column(0), batch.column(1)
    if pa.types.is_list(lists.type) or pa.types.is_large_list(lists.type):
        row = pc.list_parent_indices(lists).to_numpy()
        texts = pc.list_flatten(lists)
        element = np.arange(len(row)) - np.searchsorted(row, row)
    else:
        row, texts, element = np.arange(len(lists)), lists, np.zeros(len(lists), np.int64)
    if texts.null_count:
        full = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        row, element, texts = row[full], element[full], texts.take(pa.array(full))
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, "right")) - 1)
        lo, hi = bounds[first], bounds[last]
        used = first + np.flatnonzero(np.diff(bounds[first : last + 1]))
        if len(used):
            yield ids.take(pa.array(row[used])), element[used], Tokens(data[lo:hi], bounds[used] - lo, bounds[used + 1] - lo)
        first = last


def _unique(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    t = pa.table(columns, names=names).group_by(names, use_threads=False).aggregate([]).select(names).combine_chunks()
    return t.to_batches()[0] if len(t) else pa.RecordBatch.from_arrays([c[:0] for c in columns], names)


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, element, t in _blocks(batch):
            tokens, own, near, _ = _paths(t, element)
            objects = pa.array(np.flatnonzero(t.kind[tokens] == OBJ))
            rows = ids.take(pa.array(t.doc[tokens]).take(objects))
            yield _unique([rows, own.take(objects), near.take(objects)], [batch.schema.names[0], "node_path", "parent_path"])


def _value_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, element, t in _blocks(batch):
            tokens, own, near, container = _paths(t, element)
            leaf = np.flatnonzero(~container)
            text = leaf[t.kind[tokens[leaf]] == STRING]
            bare = leaf[t.kind[tokens[leaf]] == SCALAR]
            at = pa.array(np.r_[text, bare])
            values = pa.concat_arrays([t.text(tokens[text], 1), t.text(tokens[bare], 0)])
            first = pc.utf8_slice_codeunits(values, 0, 1)
            kinds = pc.if_else(
                pa.array(np.arange(len(at)) < len(text)), "string",
                pc.if_else(pc.is_in(first, pa.array(["t", "f"])), "boolean", pc.if_else(pc.equal(first, "n"), "null", "number")),
            )
            yield _unique(
                [ids.take(pa.array(t.doc[tokens]).take(at)), own.take(at), near.take(at), kinds, values],
                [batch.schema.names[0], "value_path", "node_path", "kind", "value"],
            )


def _id_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def json_nodes(df: DataFrame, key: str = "page_id", texts: str = "json_ld") -> DataFrame:
    """(key, node_path, parent_path) of each JSON object in the texts (a string or a list of strings).

    node_path is the text's position, then the keys and array positions down to the object, joined by
    '/'; parent_path is that of the nearest object around, or ''.
    """
    return df.select(key, texts).mapInArrow(_node_batches, f"`{key}` {_id_type(df, key)}, node_path string, parent_path string")


def json_values(df: DataFrame, key: str = "page_id", texts: str = "json_ld") -> DataFrame:
    """(key, value_path, node_path, kind, value) of each string, number, boolean and null; node_path is
    that of the nearest object around, the parent of the value's row."""
    return df.select(key, texts).mapInArrow(_value_batches, f"`{key}` {_id_type(df, key)}, value_path string, node_path string, kind string, value string")
