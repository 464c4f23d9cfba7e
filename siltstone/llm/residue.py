"""Template residue and error pages: a regularised linear classifier over lines, trained on weak labels.

Each of a page's own lines (those that `boilerplate` keeps) is classified from hashed n-grams of its
words and marks, its length and the page's title and size. No line is labelled by hand. A line is
taken as residue for training if it is short and has a phrase of error pages, script notices or
unfilled templates, or if it is on pages of error statuses far more often than pages are; lines that
have such a phrase within longer prose (they write about it) and all other lines are taken as none.
The phrases and statuses only label: what is reported is what the classifier says of every line.

Defined results: null, empty and blank texts have no residue of their own; they are reported only if
the body's script notice is classified as residue; pages without a body or status are judged by their
lines alone; repeated rows give one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import boilerplate, phrases
from siltstone.session import written

# The shared phrases and further turns of them; all of them only label.
ERROR_PHRASES = phrases.ERRORS + r"|something broke|lives at this address"
UNFILLED = phrases.UNFILLED + r"|\bnan\b|your own words|edit it in"
PHRASES = f"{ERROR_PHRASES}|{phrases.SCRIPTS}|{UNFILLED}"
#: pages scored at a time, and token hashes kept by a task
ROWS, KEPT_TOKENS = 1_000, 200_000
TOKEN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]{1,3}")


@dataclass(frozen=True)
class Training:
    #: the fit's sample: at most so many weakly labelled lines of either kind, chosen by hash
    most_residue: int = 6_000
    most_other: int = 12_000
    short_words: int = 20
    #: a line's pages have error statuses this many times as often as all pages, on two pages at least
    status_lift: float = 8.0
    bits: int = 18
    epochs: int = 25
    rate: float = 0.3
    decay: float = 1e-5
    seed: int = 5


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


class Features:
    """Hashed features of lines; the dictionary of token hashes is bounded."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.seen: dict[str, int] = {}

    def _token(self, t: str) -> int:
        if len(self.seen) > KEPT_TOKENS:
            self.seen.clear()
        h = self.seen.get(t)
        if h is None:
            form = t.lower()
            # names and numbers vary: they count by their shape
            if form[0].isdigit():
                form = "0" * min(len(form), 4)
            h = 1469598103934665603
            for byte in form.encode("utf-8", "replace"):
                h = ((h ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
            self.seen[t] = h
        return h

    def __call__(self, lines: list[str], alone: list[bool], is_title: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(line, feature) pairs as two arrays, lines in ascending order."""
        cut = [TOKEN.findall(x) for x in lines]
        sizes = np.array([len(c) for c in cut], np.int64)
        tokens = np.fromiter((self._token(t) for c in cut for t in c), np.uint64, sizes.sum())
        line = np.repeat(np.arange(len(lines)), sizes)
        words = np.array([len(x.split()) for x in lines], np.int64)
        bucket = np.minimum(np.log2(words + 1).astype(np.int64), 7)
        visible = np.array([max(1, len(x) - x.count(" ")) for x in lines])
        letters = np.array([sum(map(len, regex.findall(r"\p{L}+", x))) for x in lines])
        shape = bucket * 8 + np.minimum(letters * 5 // visible, 4)
        k = np.uint64
        with np.errstate(over="ignore"):
            one = _mix(tokens + k(1))
            crossed = _mix(tokens * k(3) + (bucket[line] > 4).astype(np.uint64) + k(2))
            same2 = line[1:] == line[:-1]
            two = _mix(tokens[:-1] * k(5) + tokens[1:] + k(7))[same2]
            same3 = line[2:] == line[:-2]
            three = _mix(tokens[:-2] * k(25) + tokens[1:-1] * k(5) + tokens[2:] + k(11))[same3]
            starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
            head = _mix(tokens[starts] * k(13) + k(17))
            own = np.arange(len(lines))
            dense = [_mix(x.astype(np.uint64) + k(base)) for x, base in ((shape, 1_000), (np.array(alone, np.int64) * 8 + bucket, 2_000), (np.array(is_title, np.int64), 3_000), (np.array([min(x.count("`"), 2) for x in lines], np.int64), 4_000))]
        rows = np.concatenate([line, line, line[1:][same2], line[2:][same3], line[starts], *([own] * len(dense))])
        cols = np.concatenate([one, crossed, two, three, head, *dense]) >> self.shift
        order = np.argsort(rows, kind="stable")
        return rows[order], cols[order].astype(np.int64)


class Classifier:
    """Logistic regression with L2 decay, fitted by AdaGrad over whole mini-batches."""

    def __init__(self, bits: int):
        self.bits, self.weights, self.bias = bits, np.zeros(1 << bits, np.float32), 0.0

    def scores(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        size = np.bincount(rows, minlength=n)
        return np.bincount(rows, self.weights[cols], n) / np.sqrt(np.maximum(size, 1)) + self.bias

    def fit(self, rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, t: Training) -> Classifier:
        n = len(labels)
        rng = np.random.default_rng(t.seed)
        bounds = np.searchsorted(rows, np.arange(n + 1))
        balance = np.where(labels > 0, n / max(1, 2 * labels.sum()), n / max(1, 2 * (n - labels.sum())))
        squares, bias_square = np.full(1 << self.bits, 1e-4, np.float32), 1e-4
        for _ in range(t.epochs):
            order = rng.permutation(n)
            for part in np.array_split(order, max(1, n // 256)):
                sizes = bounds[part + 1] - bounds[part]
                at = np.repeat(bounds[part] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                local, c = np.repeat(np.arange(len(part)), sizes), cols[at]
                scale = 1 / np.sqrt(np.maximum(sizes, 1))
                z = np.bincount(local, self.weights[c], len(part)) * scale + self.bias
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * balance[part] / len(part)
                used, where = np.unique(c, return_inverse=True)
                grad = np.bincount(where, g[local] * scale[local], len(used)) + t.decay * self.weights[used]
                squares[used] += grad * grad
                self.weights[used] -= t.rate * grad / np.sqrt(squares[used])
                bias_square += g.sum() ** 2
                self.bias -= t.rate * g.sum() / np.sqrt(bias_square)
        return self


def own_lines(html: DataFrame, urls: DataFrame, fetches: DataFrame) -> DataFrame:
    """(page_id, site, status, title, lines) with the page's own lines, as a written table."""
    status = fetches.select("page_id", "status").groupBy("page_id").agg(F.max("status").alias("_status"))
    # met before the texts move, so that they do so once
    html = html.select("page_id", "title", "text").join(status, "page_id", "left").withColumn("_own_title", F.col("title"))
    rows = boilerplate.marked(boilerplate.pages(html, urls, ("_own_title", "_status")))
    kept = F.coalesce(F.filter(boilerplate.own_lines(), lambda x: F.trim(x) != ""), F.array().cast("array<string>"))
    return written(rows.select("page_id", F.col("domain").alias("site"), F.coalesce("_own_title", F.lit("")).alias("title"), kept.alias("lines"), F.col("_status").alias("status")))


def _lines(own: DataFrame) -> DataFrame:
    """(id, site, line, is_title, alone, bad) of every own line; id is the hash of site and line."""
    body = F.filter("lines", lambda x: x != F.col("title"))
    bad = F.coalesce(F.col("status") >= 400, F.lit(False))
    line = own.select("site", "title", bad.alias("bad"), (F.size(body) <= 2).alias("alone"), F.explode("lines").alias("line"))
    return line.select(F.xxhash64("site", "line").alias("id"), "site", "line", (F.col("line") == F.col("title")).alias("is_title"), "alone", "bad")


def weak_labels(own: DataFrame, t: Training = Training()) -> DataFrame:
    """(id, alone, is_title, residue, hard) of distinct lines of a site, with what they are taken as, as a
    written table. Of the lines only hashes and what their words say are shuffled, never their text."""
    base = own.agg(F.avg(F.coalesce(F.col("status") >= 400, F.lit(False)).cast("int"))).first()[0] or 0.0
    letters = F.regexp_replace("line", r"[^\p{L}]+", "")
    words = F.size(F.split(F.trim("line"), r"\s+"))
    share = F.length(letters) / F.greatest(F.lit(1), F.length(F.regexp_replace("line", r"\s+", "")))
    fill = F.regexp_count(F.lower("line"), F.lit(r"(?<!\p{L})(?:" + phrases.FILLER_WORDS.replace(" ", "|") + r"|sed|amet|dolor|nulla|elit)(?!\p{L})")) / words
    said, marked = F.lower("line").rlike(PHRASES), F.contains("line", F.lit("`"))
    line = _lines(own).select(
        "id", "is_title", "alone", "bad", F.xxhash64(F.lower(letters)).alias("form"), (words <= t.short_words).alias("short"), said.alias("said"),
        marked.alias("marked"), (share >= 0.4).alias("lettered"), (F.length("line") <= 30).alias("brief"), (fill >= 0.2).alias("filled"),
    )
    line = line.groupBy("id").agg(
        F.max("is_title").alias("is_title"), F.max("alone").alias("alone"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("bad").cast("int")).alias("bad"),
        *(F.first(c).alias(c) for c in ("form", "short", "said", "marked", "lettered", "brief", "filled")),
    )
    line = written(line)
    rates = line.groupBy("form").agg(F.sum("n").alias("all"), F.sum("bad").alias("all_bad")).where("all_bad > 0")
    lifted = rates.where((F.col("all") > 1) & (F.col("all_bad") > F.col("all") * (base * t.status_lift))).select("form", F.lit(True).alias("lifted"))
    line = line.join(lifted, "form", "left")
    c = F.col
    phrase = c("said") & (c("lettered") | c("brief")) & c("short") & ~c("marked")
    residue = ~c("is_title") & (phrase | c("filled") | (F.coalesce("lifted", F.lit(False)) & c("short")))
    return written(line.select("id", "alone", "is_title", residue.alias("residue"), (~residue & (c("said") | c("marked"))).alias("hard")))


def _sample(own: DataFrame, labels: DataFrame, t: Training) -> list:
    """The fit's bounded sample, chosen by hash thresholds taken from counts. Lines that write about
    residue come first among the others. Their texts are fetched by a second read of the lines."""
    kind = F.when(F.col("residue"), 0).when(F.col("hard"), 1).otherwise(2)
    most = (t.most_residue, t.most_other // 3, t.most_other)
    rows = labels.select("id", "alone", "is_title", "residue", kind.alias("kind"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("order"))
    counts = {r[0]: r[1] for r in rows.groupBy("kind").agg(F.count(F.lit(1))).collect()}
    limit = F.lit(0)
    for k, n in counts.items():
        limit = F.when(F.col("kind") == k, F.lit(int((1 << 40) * min(1.0, most[k] / n)))).otherwise(limit)
    # a bounded set, of whose size the counts are proof
    chosen = F.broadcast(rows.where(F.col("order") < limit).drop("order", "kind"))
    line = _lines(own).select("id", "site", "line").join(chosen, "id")
    return sorted(line.groupBy("id", "alone", "is_title", "residue").agg(F.min("site").alias("site"), F.min("line").alias("line")).collect(), key=lambda r: r.id)


def fit(own: DataFrame, t: Training = Training(), sites=lambda site: True) -> Classifier:
    """The classifier, fitted on the driver to the sample's lines of the given sites."""
    rows = [r for r in _sample(own, weak_labels(own, t), t) if sites(r.site)]
    model = Classifier(t.bits)
    if not rows:
        return model
    r, c = Features(t.bits)([x.line for x in rows], [x.alone for x in rows], [x.is_title for x in rows])
    return model.fit(r, c, np.array([float(x.residue) for x in rows]), t)


def validate(own: DataFrame, t: Training = Training(), part: int = 5) -> dict[str, float]:
    """Precision and recall against the weak labels on sites that the fit has not seen."""
    unseen = lambda site: hash_of(site) % part == 0
    model = fit(own, t, lambda site: not unseen(site))
    rows = [r for r in _sample(own, weak_labels(own, t), t) if unseen(r.site)]
    r, c = Features(t.bits)([x.line for x in rows], [x.alone for x in rows], [x.is_title for x in rows])
    said, is_ = model.scores(r, c, len(rows)) > 0, np.array([x.residue for x in rows], bool)
    both = float((said & is_).sum())
    return {"lines": float(len(rows)), "precision": both / max(1.0, float(said.sum())), "recall": both / max(1.0, float(is_.sum()))}


def hash_of(site: str | None) -> int:
    return sum((i + 1) * b for i, b in enumerate((site or "").encode()))


def _score(own: DataFrame, model: Classifier) -> DataFrame:
    """(page_id, residue, empty) of the rows: the most residue-like line's score, and whether there is
    no line besides the title."""
    shared = own.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        features = Features(m.bits)
        for b in (whole.slice(at, ROWS) for whole in it for at in range(0, len(whole), ROWS)):
            index: dict[tuple[str, bool, bool], int] = {}
            uses, empty = [], []
            for title, lines in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body = [x for x in lines if x != title]
                uses.append([index.setdefault((x, len(body) <= 2, False), len(index)) for x in body])
                empty.append(not body)
            keys = list(index)
            r, c = features(*([k[i] for k in keys] for i in range(3)))
            scores = m.scores(r, c, len(keys)) if keys else np.zeros(0)
            best = [float(scores[u].max()) if u else None for u in uses]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.float64()), pa.array(empty, pa.bool_())], ["page_id", "score", "empty"])

    return own.select("page_id", "title", "lines").mapInArrow(batches, f"page_id {own.schema['page_id'].dataType.simpleString()}, score double, empty boolean")


def residue_pages(html: DataFrame, urls: DataFrame, fetches: DataFrame, t: Training = Training()) -> DataFrame:
    """(page_id) of the pages on which residue stands as the page's own content."""
    own = own_lines(html, urls, fetches)
    model = fit(own, t)
    scored = written(_score(own, model))
    empty = scored.where("empty").select("page_id").distinct()
    # the body's notices meet only the pages without content of their own
    notice = F.regexp_extract_all("body", F.lit(r"(?is)<noscript\b[^>]*>(.*?)(?:</noscript|\z)"), F.lit(1))
    notices = fetches.where(F.contains(F.lower("body"), F.lit("<noscript"))).select(
        "page_id", F.lit("").alias("title"), F.transform(notice, boilerplate.strip_markup).alias("lines"),
    )
    said = _score(notices.join(empty, "page_id", "left_semi"), model)
    return scored.where("score > 0").select("page_id").unionByName(said.where("score > 0").select("page_id")).distinct()
