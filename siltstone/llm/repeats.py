"""Lines repeated across one source's documents, found by content-defined chunks.

Each entry's letters form a byte sequence that is cut where a rolling hash of its last bytes says so,
so equal stretches give equal chunks wherever they stand. Chunks are counted by source over distinct
documents. `without_chunks` cuts those that are repeated, also inside longer entries; for
`repeated_entries`, entries all of whose chunks are repeated are the candidates, and only they meet the
exact count of equal entries. Both counts group by (source, chunk or line) with map-side sums, so one source
with a third of all documents, or one line on all its pages, never lies in one task.

Defined results: null lists, null entries and entries without a letter are no lines; documents without
a source, or whose source is null, have no repeated lines; a repeated row counts once for its document;
several equal entries of one document count once for it and are all reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import written

#: Bytes in the rolling window; a chunk ends where the hash's low bits are 0: one byte in 2**CUT_BITS.
WINDOW, CUT_BITS = 16, 6
LEAST_DOCUMENTS = 5
LETTER = regex.compile(r"\p{L}")
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def line_form(entry: Column) -> Column:
    """What two entries must share to be the same line: their letters, without regard to case."""
    return F.regexp_replace(F.lower(entry), r"[^\p{L}]+", "")


def _cuts(data: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Whether a chunk ends at each byte, by the rolling hash of the last WINDOW bytes."""
    rolling, gear = np.zeros(len(data), np.uint32), _GEAR[data]
    for k in range(min(WINDOW, len(data))):
        rolling[k:] += gear[: len(data) - k] << np.uint32(k) if k else gear
    return ((rolling >> np.uint32(WINDOW - CUT_BITS)) & np.uint32((1 << CUT_BITS) - 1) == 0) & (within >= WINDOW)


def _ends(data: np.ndarray) -> np.ndarray:
    """The last byte of each chunk of one entry."""
    return np.union1d(np.flatnonzero(_cuts(data, np.arange(len(data)))), len(data) - 1)


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, hash) of each chunk, in order, of the entries data[starts:ends], which follow each other."""
    n = len(data)
    within = np.arange(n) - np.repeat(starts, ends - starts)
    cut = _cuts(data, within)
    last = np.union1d(np.flatnonzero(cut), ends - 1)
    first = np.r_[0, last[:-1] + 1]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), _BASE, np.uint64)])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), _INVERSE, np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])]
        h = (sums[last + 1] - sums[first]) * inverse[first]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.searchsorted(ends, first, "right"), h.view(np.int64)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        lists = b.column(1)
        row = pc.list_parent_indices(lists).to_numpy()
        flat = pc.list_flatten(lists)
        number = np.arange(len(row)) - np.searchsorted(row, row)
        sizes = pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        used = np.flatnonzero(sizes)
        words = flat.take(pa.array(used)).cast(pa.large_binary())
        ends = np.cumsum(sizes[used])
        data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        entry, h = chunks(data, ends - sizes[used], ends) if len(used) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        digest = pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in words.to_pylist()], pa.binary())
        offsets = np.searchsorted(entry, np.arange(len(used) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(number[used].astype(np.int32)), digest, pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))], ["no", "line", "chunks"])
        by_row = np.searchsorted(row[used], np.arange(len(b) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(by_row), entries)], [b.schema.names[0], "entries"])


def chunked(documents: DataFrame, sources: DataFrame, key: str, source: str, entries: str) -> DataFrame:
    """(key, source, no, line, chunks) of each entry with a letter, as a written table. Only hashes are
    shuffled to meet the sources; the texts stay where they are read."""
    kind = documents.schema[key].dataType.simpleString()
    forms = documents.select(key, F.transform(entries, line_form).alias("forms"))
    hashed = forms.mapInArrow(_batches, f"`{key}` {kind}, entries array<struct<no int, line binary, chunks array<bigint>>>")
    named = sources.select(key, F.col(source).alias("source")).where("source is not null").distinct()
    return written(hashed.where(F.size("entries") > 0).join(named, key).select(F.col(key).alias("key"), "source", F.inline("entries")))


def repeated_chunks(table: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(source, chunk, n_documents) of the chunks of `chunked` on so many documents of a source or more."""
    each = table.select("key", "source", F.explode(F.array_distinct("chunks")).alias("chunk")).distinct()
    return each.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n_documents")).where(F.col("n_documents") >= least)


def _candidates(table: DataFrame, least: int) -> DataFrame:
    """Entries all of whose chunks are repeated."""
    each = table.select("key", "source", "no", "line", F.size("chunks").alias("n"), F.explode("chunks").alias("chunk"))
    held = each.join(repeated_chunks(table, least), ["source", "chunk"])
    whole = held.groupBy("key", "source", "no", "line").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("n"))
    # a row that occurs twice has its chunks twice
    return whole.where("held >= n").select("key", "source", "no", "line")


def repeated_entries(documents: DataFrame, sources: DataFrame, key: str = "page_id", source: str = "registrable_domain", entries: str = "paragraphs", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Distinct (key, para_no) of entries whose line is on so many documents of one source or more."""
    found = written(_candidates(chunked(documents, sources, key, source, entries), least))
    lines = found.select("source", "line", "key").distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("source", "line")
    return found.join(lines, ["source", "line"]).select(F.col("key").alias(key), F.col("no").alias("para_no")).distinct()


def without_repeats(documents: DataFrame, sources: DataFrame, key: str = "page_id", source: str = "registrable_domain", entries: str = "paragraphs", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """documents with the repeated entries cut from the list, and their number in `n_cut`; rows without
    any are unchanged, null lists stay null."""
    cut = repeated_entries(documents, sources, key, source, entries, least).groupBy(key).agg(F.collect_set("para_no").alias("_cut"))
    out = documents.drop("n_cut", "_cut").join(cut, key, "left")
    kept = F.filter(entries, lambda _, i: ~F.array_contains("_cut", i.cast("int")))
    return out.withColumn("n_cut", F.coalesce(F.size("_cut"), F.lit(0))).withColumn(entries, F.when(F.col("_cut").isNull(), F.col(entries)).otherwise(kept)).drop("_cut")


def _spans(entry: str, form: str, hot: set[int]) -> list[tuple[int, int]]:
    """The character ranges of the entry to be cut: runs of repeated chunks, inwards to whole words. A
    chunk shorter than the rolling window, as an entry's last may be, only goes with its neighbours."""
    data = np.frombuffer(form.encode(), np.uint8)
    if not len(data):
        return []
    _, hashes = chunks(data, np.array([0]), np.array([len(data)]))
    last = _ends(data)
    held = np.array([h in hot for h in hashes.tolist()])
    sizes = np.diff(np.r_[-1, last])
    if not held.all():
        held &= (sizes >= WINDOW) | np.r_[False, held[:-1]]
    if not held.any():
        return []
    at = [i for i, c in enumerate(entry) for x in c.lower() if LETTER.match(x)]
    if len(at) != len(form):
        return [(0, len(entry))] if held.all() else []
    letter = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte, the number of its letter
    first = np.r_[0, last[:-1] + 1]
    out: list[list[int]] = []
    for k in np.flatnonzero(held):
        a, z = int(letter[first[k]]), int(letter[last[k]])
        if out and out[-1][1] == a - 1:
            out[-1][1] = z
        else:
            out.append([a, z])
    spans = []
    for a, z in out:
        start = 0 if a == 0 else at[a]
        end = len(entry) if z == len(at) - 1 else at[z + 1]
        while 0 < start < end and entry[start - 1].isalnum():
            start += 1
        while start < end < len(entry) and entry[end - 1].isalnum():
            end -= 1
        if start < end:
            spans.append((start, end))
    return spans


def without_chunks(documents: DataFrame, sources: DataFrame, key: str = "page_id", source: str = "registrable_domain", entries: str = "paragraphs", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """documents with the chunks cut that stand on so many documents of a source or more, wherever in an
    entry, and the number of characters cut in `n_cut`. An entry that is cut whole goes from the list;
    rows without a repeated chunk are unchanged, null lists stay null."""
    table = chunked(documents, sources, key, source, entries)
    each = table.select("key", "source", F.explode("chunks").alias("chunk"))
    hot = each.join(repeated_chunks(table, least), ["source", "chunk"]).groupBy("key").agg(F.collect_set("chunk").alias("_hot"))
    rows = documents.drop("n_cut", "_hot", "_forms").withColumn("_forms", F.transform(entries, line_form)).join(hot.withColumnRenamed("key", key), key, "left")
    names = [c for c in rows.columns if c not in ("_hot", "_forms")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            get = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            lists, cut = [], []
            for own, forms, hot in zip(*(get[c].to_pylist() for c in (entries, "_forms", "_hot")), strict=True):
                cut.append(0)
                if hot:
                    hot, kept = set(hot), []
                    for entry, form in zip(own, forms, strict=True):
                        spans = _spans(entry, form, hot) if form else []
                        cut[-1] += sum(z - a for a, z in spans)
                        rest = "".join(entry[a:z] for a, z in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(entry)], strict=True)) if spans else entry
                        if not spans or any(map(str.isalpha, rest)):
                            kept.append(rest)
                    own = kept
                lists.append(own)
            columns = [pa.array(lists, get[c].type) if c == entries else get[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.int64())], [*names, "n_cut"])

    return rows.mapInArrow(batches, T.StructType([rows.schema[c] for c in names]).add("n_cut", "long"))
