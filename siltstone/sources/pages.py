"""Pages as they are saved: what a scan gets, what it leaves out, and bodies that are still bytes."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes that a body may have, compressed and inflated.
WIRE_BYTES, INFLATED_BYTES = 3 * 1024 * 1024, 12 * 1024 * 1024


def saved(inventory: DataFrame, bodies: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(pages, notes): the inventory's pages of a good status with their body, and one note (key, note) for
    each that has none or another status. Both sides meet by the key."""
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    has_body = bodies.where("body is not null").select(key, "body")
    pages = inventory.where(good).join(has_body, key)
    missing = inventory.where(good).join(has_body.select(key), key, "left_anti").select(key, F.lit("missing body").alias("note"))
    other = inventory.where(~good).select(key, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none"))).alias("note"))
    return pages, other.unionByName(missing)


def latest(runs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key; of equally late ones that with the highest tie breaker."""
    row = F.struct(*(F.col(f"`{c}`") for c in runs.columns))
    return runs.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(at, tie)).alias("_row")).select("_row.*")


def budgeted(df: DataFrame, most_pages: int, most_bytes: int, size: Column, site: str = "site", order: str = "page_id") -> DataFrame:
    """Of each site the first pages in order, until the page budget or the byte budget is used up."""
    w = W.partitionBy(site).orderBy(order)
    # the page budget first: Spark then keeps no more rows of a site before the shuffle
    first = df.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= most_pages)
    used = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("used_before", used).where(F.col("used_before") < most_bytes).drop("_turn")


def _inflate(raw: bytes | None, encoding: str | None, most: int) -> tuple[bytes | None, str]:
    """The body and what was wrong: '', 'truncated', 'decompression_limit' or 'undecodable'."""
    if raw is None:
        return None, ""
    note, raw = ("truncated", raw[:WIRE_BYTES]) if len(raw) > WIRE_BYTES else ("", raw)
    kind = (encoding or "").strip().lower()
    if kind not in ("gzip", "x-gzip", "deflate"):
        return raw, note
    # gzip by its head; deflate with or without one
    for bits in (31,) if kind != "deflate" else (15, -15):
        inflater = zlib.decompressobj(bits)
        try:
            out = inflater.decompress(raw, most)
        except zlib.error:
            continue
        return out, "decompression_limit" if inflater.unconsumed_tail else note
    return raw, "undecodable"


def inflated(df: DataFrame, raw: str = "raw", encoding: str = "encoding", most: int = INFLATED_BYTES) -> DataFrame:
    """df with `body_bytes` and `note`. Python, since no native function inflates; bounded by `most` bytes a
    body, so that a small body can't fill a worker."""

    @F.arrow_udf("struct<body_bytes binary, note string>")
    def read(raws: pa.Array, encodings: pa.Array) -> pa.Array:
        rows = [_inflate(*x, most) for x in zip(raws.to_pylist(), encodings.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["body_bytes", "note"])

    return df.drop("body_bytes", "note").withColumn("_read", read(F.col(raw), F.col(encoding))).select("*", "_read.*").drop("_read")


#: Charset names that Spark decodes; others are tried as UTF-8.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}


def charset_of(content_type: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w.-]+)", 1))


def decoded(raw: Column, content_type: Column) -> Column:
    """The text of bytes: by the charset named if they are valid in it, else UTF-8, else Latin-1, in which all
    bytes are."""
    named = charset_of(content_type)
    utf8 = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    latin = F.decode(raw, "ISO-8859-1")
    out = F.when(named.isin("iso-8859-1", "latin-1", "latin1"), latin)
    for name in ("utf-16", "utf-16le", "utf-16be"):
        out = out.when(named == name, F.decode(raw, CHARSETS[name]))
    return F.coalesce(out, utf8, latin)
