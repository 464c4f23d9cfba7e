"""Languages of documents and of their segments, by a bidirectional gated recurrent network over bytes.

The network reads a sentence in steps of STEP bytes in both directions and gives every position's
language; a sentence's probabilities are the mean of its positions', a document's those of its
sentences by length. It is trained in numpy by backpropagation through time, on a bounded sample of
sentences whose pages carry a usable label: first on all of them, then without those that the first
network contradicts, since labels may be wrong. The trained network is kept and loaded again.

Defined results: null, blank and meaningless labels name no language; texts without a sentence have no
language (null, confidence 0) and no segments; equal sentences are read once a batch; very long
sentences are read whole, in windows of at most LONGEST bytes whose positions are pooled together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import boilerplate, quality
from siltstone.session import shared_folder, written

# The languages told apart, with their three-letter codes.
CODES = {"en": "eng", "de": "deu ger", "fr": "fra fre", "es": "spa", "pt": "por", "nl": "nld dut", "it": "ita"}
LANGUAGES = tuple(CODES)
STEP, LONGEST = 4, 480
#: raised when the network's form or training changes, so that kept ones are not taken for new ones
VERSION = 1
SENTENCE = regex.compile(r"(?<=[.!?…][\"'”’»)]*)\s+|\n+")


def named(label: Column) -> Column:
    """The language that a label names, by two letters; null if it names none of those told apart."""
    code = F.lower(F.element_at(F.split(F.trim(label), "[-_]"), 1))
    out = F.when(code.isin(*LANGUAGES), code)
    for two, three in CODES.items():
        out = out.when(code.isin(*three.split()), two)
    return out


def sentences(text: str) -> list[str]:
    """Sentences of at least four words."""
    return [s for s in SENTENCE.split(text) if len(s.split()) >= 4]


@dataclass(frozen=True)
class Training:
    #: sentences of each language in the sample, chosen by hash
    each: int = 1_500
    hidden: int = 20
    embedding: int = 8
    batch: int = 128
    rounds: tuple[int, int] = (700, 500)
    bytes: int = 96
    rate: float = 0.01
    seed: int = 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embedding of bytes, a GRU in each direction over steps of STEP bytes, and a softmax a position."""

    def __init__(self, t: Training, classes: int = len(LANGUAGES)):
        rng = np.random.default_rng(t.seed)
        h, e = t.hidden, t.embedding
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h, self.e = h, e
        self.p = {"E": init(256, e) * 4, "O": init(2 * h, classes), "o": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(STEP * e, 3 * h), f"U{d}": init(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction, in the positions' order. x: (steps, rows, 3h)."""
        h, u = self.h, self.p[f"U{d}"]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        state = np.zeros((x.shape[1], h), np.float32)
        out, tape = np.empty((len(x), x.shape[1], h), np.float32), []
        for s in steps:
            hu = state @ u
            zr = _sigmoid(x[s, :, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[s, :, 2 * h :] + r * hu[:, 2 * h :])
            new = n + z * (state - n)
            m = mask[s][:, None]
            if keep:
                tape.append((s, state, z, r, n, hu[:, 2 * h :], m))
            state = np.where(m, new, state)
            out[s] = state
        return out, tape

    def probabilities(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(steps, rows, classes) of data (steps, rows, STEP) of bytes."""
        p, k = self.p, 3 * self.h
        x = p["E"][data].reshape(*mask.shape, -1) @ np.concatenate([p["Wf"], p["Wb"]], 1) + np.concatenate([p["cf"], p["cb"]])
        states = [self._scan(x[:, :, i * k : (i + 1) * k], mask, d, False)[0] for i, d in enumerate("fb")]
        return _softmax(np.concatenate(states, 2) @ self.p["O"] + self.p["o"])

    def gradients(self, data: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the valid positions and its gradients, by backpropagation through time."""
        p, h = self.p, self.h
        steps, rows = mask.shape
        emb = p["E"][data].reshape(steps, rows, -1)
        states, tapes = {}, {}
        for d in "fb":
            states[d], tapes[d] = self._scan(emb @ p[f"W{d}"] + p[f"c{d}"], mask, d, True)
        both = np.concatenate([states["f"], states["b"]], 2)
        prob = _softmax(both @ p["O"] + p["o"])
        at = prob[:, np.arange(rows), labels]
        total = mask.sum()
        loss = float(-(np.log(at + 1e-9) * mask).sum() / total)
        g = prob
        g[:, np.arange(rows), labels] -= 1
        g *= (mask / total)[:, :, None]
        grads = {"O": np.einsum("srh,src->hc", both, g), "o": g.sum((0, 1))}
        back = g @ p["O"].T
        d_emb = np.zeros_like(emb)
        for k, d in enumerate("fb"):
            u = p[f"U{d}"]
            du, carry = np.zeros_like(u), np.zeros((rows, h), np.float32)
            dx = np.zeros((steps, rows, 3 * h), np.float32)
            for s, before, z, r, n, hn, m in reversed(tapes[d]):
                total_g = carry + back[s, :, k * h : (k + 1) * h]
                dn_out = np.where(m, total_g, 0)
                dz = dn_out * (before - n) * z * (1 - z)
                dn = dn_out * (1 - z) * (1 - n * n)
                dr = dn * hn * r * (1 - r)
                dx[s] = np.concatenate([dz, dr, dn], 1)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                du += before.T @ dhu
                carry = np.where(m, dn_out * z, total_g) + dhu @ u.T
            grads[f"U{d}"] = du
            grads[f"W{d}"] = np.einsum("sre,srk->ek", emb, dx)
            grads[f"c{d}"] = dx.sum((0, 1))
            d_emb += dx @ p[f"W{d}"].T
        hot = np.zeros((256, self.e), np.float32)
        flat = d_emb.reshape(-1, self.e)
        for j in range(self.e):
            hot[:, j] = np.bincount(data.reshape(-1), flat[:, j], 256)
        grads["E"] = hot
        return loss, grads


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, rows, STEP) of bytes and (steps, rows), whether the position has a byte."""
    sizes = np.array([len(t) for t in texts])
    steps = -(-int(sizes.max()) // STEP)
    flat = np.frombuffer(b"".join(t.ljust(steps * STEP, b"\0") for t in texts), np.uint8)
    return np.ascontiguousarray(flat.reshape(len(texts), steps, STEP).transpose(1, 0, 2)), (np.arange(steps)[:, None] * STEP < sizes)


def train(texts: list[str], labels: np.ndarray, t: Training = Training()) -> Network:
    """Two rounds; the second leaves out the sentences whose label the first network contradicts."""
    network, rng = Network(t), np.random.default_rng(t.seed)
    data = [s.encode() for s in texts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    kept, done = np.arange(len(data)), 0
    for rounds in t.rounds:
        groups = [kept[labels[kept] == c] for c in range(len(LANGUAGES))]
        groups = [g for g in groups if len(g)]
        for _ in range(rounds if len(kept) else 0):
            done += 1
            rows = np.concatenate([rng.choice(g, t.batch // len(groups) + 1) for g in groups])
            crops = []
            for i in rows:
                start = int(rng.integers(0, max(1, len(data[i]) - t.bytes // 2)))
                crops.append(data[i][start : start + int(rng.integers(t.bytes // 3, t.bytes + 1))])
            x, mask = _padded(crops)
            _, grads = network.gradients(x, mask, labels[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = t.rate * min(1.0, done / 30) * (1 - 0.9 * done / sum(t.rounds))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[k] -= (rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
        if len(kept):
            p = pooled(network, texts)
            kept = np.flatnonzero((p.argmax(1) == labels) | (p.max(1) < 0.6))
    return network


def pooled(network: Network, texts: list[str], cells: int = 40_000) -> np.ndarray:
    """(texts, languages) of probabilities, the means over each text's positions."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace")
        # windows of about equal size, so that none is too short to tell
        n = max(1, -(-len(b) // LONGEST))
        size = -(-len(b) // n) or 1
        for k in range(n):
            pieces.append(b[k * size : (k + 1) * size] or b" ")
            owner.append(i)
    sizes = np.array([len(x) for x in pieces])
    sums, weights = np.zeros((len(texts), len(LANGUAGES))), np.zeros(len(texts))
    owner = np.array(owner)
    order = np.argsort(sizes, kind="stable")
    first = 0
    while first < len(order):
        # rows of about equal length, as many as keep the batch's positions within cells
        part = order[first : first + 256]
        part = order[first : first + max(1, cells * STEP // max(1, int(sizes[part[-1]])))]
        first += len(part)
        x, mask = _padded([pieces[i] for i in part])
        p = network.probabilities(x, mask)
        np.add.at(sums, owner[part], (p * mask[:, :, None]).sum(0))
        np.add.at(weights, owner[part], mask.sum(0))
    return sums / np.maximum(weights, 1)[:, None]


def content_lines(html: DataFrame, urls: DataFrame) -> DataFrame:
    """(page_id, label, lines): the sentences' lines of each page's own main body."""
    # lines of fewer than four words have no sentence that is read
    prose = lambda line: F.when(
        line.rlike(r"\S\s+\S+\s+\S+\s+\S"), F.get(F.transform(F.array(quality.kind_features(line)), quality.line_kind), F.lit(0)) == "sentence",
    ).otherwise(F.lit(False))
    html = html.withColumn("_main", F.transform(F.split("main_text", "\n"), lambda x: F.xxhash64(x)))
    rows = boilerplate.marked(boilerplate.pages(html, urls, ("lang", "_main"), prose))
    own = F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("hash"), (F.get("feats", i)["use"] & ~F.get("template", i)).alias("own")))
    return rows.select("page_id", named(F.col("lang")).alias("label"), "lines", own.alias("own"), "_main").mapInArrow(
        _of_main, f"page_id {html.schema['page_id'].dataType.simpleString()}, label string, lines array<string>",
    )


def _of_main(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The own lines whose hash is among those of main_text."""
    with np.errstate(over="ignore"):
        salted = lambda x, rows: x + rows * np.int64(-7046029254386353131)
        for b in it:
            lines, own, main = b.column(2), b.column(3), b.column(4)
            row, flat = pc.list_parent_indices(own).to_numpy(), own.flatten()
            inside = np.isin(salted(flat.field("hash").to_numpy(), row), salted(main.flatten().to_numpy(), pc.list_parent_indices(main).to_numpy()))
            kept = np.flatnonzero(inside & flat.field("own").to_numpy(zero_copy_only=False))
            offsets = np.searchsorted(row[kept], np.arange(len(b) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), lines.flatten().take(pa.array(kept)))],
                ["page_id", "label", "lines"],
            )


def _sample(lines: DataFrame, t: Training) -> list[tuple[str, str]]:
    """(label, line), at most t.each a language, chosen by hash."""
    line = lines.where("label is not null").select("label", F.explode("lines").alias("line")).select("label", "line", F.pmod(F.xxhash64("line"), F.lit(1 << 40)).alias("order"))
    counts = {r[0]: r[1] for r in line.groupBy("label").agg(F.count(F.lit(1))).collect()}
    # lines of the lowest hashes, a few times as many as asked for since lines repeat, in one job; only
    # these are made distinct and sent to the driver
    share = F.lit(0)
    for code, n in counts.items():
        share = F.when(F.col("label") == code, F.lit(int((1 << 40) * min(1.0, 2.0 * t.each / n)))).otherwise(share)
    taken, out = dict.fromkeys(LANGUAGES, 0), []
    for row in sorted(line.where(F.col("order") < share).distinct().collect(), key=lambda r: (r.order, r.line)):
        if taken[row.label] < t.each:
            taken[row.label] += 1
            out.append((row.label, row.line))
    return out


def fit(lines: DataFrame, t: Training = Training()) -> Network:
    """The network, trained on the driver on a sample of at most t.each lines a language. It is kept in
    the shared folder under the sample's digest: as long as that is the same, it is loaded."""
    sample = _sample(lines, t)
    digest = hashlib.blake2b(repr((VERSION, t, sample)).encode("utf-8", "replace"), digest_size=12).hexdigest()
    path = f"{shared_folder(lines.sparkSession)}/siltstone-models/language-{digest}"
    if kept := load(lines.sparkSession, path, t):
        return kept
    each = [(s, LANGUAGES.index(label)) for label, line in sample for s in sentences(line)]
    network = train([s for s, _ in each], np.array([k for _, k in each], np.int64), t)
    save(lines.sparkSession, path, network)
    return network


def save(spark: SparkSession, path: str, network: Network) -> None:
    """Written beside its place and then moved there, so that two runs at a time don't disturb each other."""
    rows = [(k, list(v.shape), v.astype("<f4").tobytes()) for k, v in network.p.items()]
    beside = f"{path}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.parquet(beside)
    new, at = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (beside, path))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at) or not files.rename(new, at):
        files.delete(new, True)


def load(spark: SparkSession, path: str, t: Training = Training()) -> Network | None:
    """A saved network; None if there is none, or only the rest of an interrupted write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    network = Network(t)
    network.p = {r.name: np.frombuffer(bytes(r.data), "<f4").reshape(r.shape).copy() for r in spark.read.parquet(path).collect()}
    return network


def _together(p: np.ndarray) -> float:
    """Confidence of a run of sentences: its surest one's, raised by the others at half their weight, since
    sentences next to each other are no independent evidence."""
    doubt = np.log(np.maximum(1 - p, 1e-12))
    return float(1 - np.exp(0.5 * doubt.sum() + 0.5 * doubt.min()))


def segments(lines: DataFrame, network: Network) -> DataFrame:
    """(page_id, label, document_lang, document_confidence, segments): segments are runs of sentences in
    one language, as (first, sentences, lang, confidence), positions counting the page's sentences."""
    shared = lines.sparkSession.sparkContext.broadcast(network)
    segment = pa.struct([("first", pa.int32()), ("sentences", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                index: dict[str, int] = {}
                uses = [[index.setdefault(s, len(index)) for line in lines for s in sentences(line)] for lines in b.column(2).to_pylist()]
                texts = list(index)
                p = pooled(shared.value, texts) if texts else np.zeros((0, len(LANGUAGES)))
                sizes = np.array([len(s) for s in texts])
                best = p.argmax(1) if texts else np.zeros(0, int)
                docs, confidences, runs = [], [], []
                for use in uses:
                    u = np.array(use, np.int64)
                    if not len(u):
                        docs.append(None)
                        confidences.append(0.0)
                        runs.append([])
                        continue
                    mean = (p[u] * sizes[u, None]).sum(0) / sizes[u].sum()
                    docs.append(LANGUAGES[int(mean.argmax())])
                    confidences.append(float(mean.max()))
                    cuts = np.flatnonzero(np.r_[True, best[u][1:] != best[u][:-1], True])
                    runs.append([{"first": int(a), "sentences": int(z - a), "lang": LANGUAGES[int(best[u[a]])], "confidence": _together(p[u[a:z], best[u[a]]])} for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(docs, pa.string()), pa.array(confidences, pa.float64()), pa.array(runs, pa.list_(segment))],
                    ["page_id", "label", "document_lang", "document_confidence", "segments"],
                )

    kind = lines.schema["page_id"].dataType.simpleString()
    return lines.mapInArrow(
        batches,
        f"page_id {kind}, label string, document_lang string, document_confidence double, segments array<struct<first:int,sentences:int,lang:string,confidence:double>>",
    )


def unnamed_languages(html: DataFrame, urls: DataFrame, least: float = 0.93, least_document: float = 0.6, t: Training = Training()) -> DataFrame:
    """(page_id, lang): languages of at least one sentence that the label does not name. The language of
    the document needs the confidence least_document, one within it needs a sentence of the confidence least."""
    lines = written(content_lines(html, urls))
    found = segments(lines, fit(lines, t))
    sure = F.transform(F.filter("segments", lambda s: s["confidence"] >= least), lambda s: s["lang"])
    whole = F.filter(F.array(F.when(F.col("document_confidence") >= least_document, F.col("document_lang"))), lambda x: x.isNotNull())
    each = found.select("page_id", "label", F.explode(F.array_distinct(F.concat(whole, sure))).alias("lang"))
    return each.where(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("page_id", "lang")


def page_segments(html: DataFrame, urls: DataFrame, t: Training = Training()) -> DataFrame:
    """Every page's language and segments; see `segments`."""
    lines = written(content_lines(html, urls))
    return segments(lines, fit(lines, t))
