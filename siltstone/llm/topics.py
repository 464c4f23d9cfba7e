"""Subject areas of documents, by interpolated n-gram language models against background models.

Texts are cut once, by native expressions, into sentences of hashed lower-case words; everything after
that is arithmetic on arrays of numbers. A sentence's language is the one whose corpus-wide word model
gives it the highest likelihood. Each subject has, in each language, a bigram model interpolated with a
unigram model, which is interpolated with the background: the bigram and unigram model of all the
corpus's sentences in that language. The weight of what was counted grows with the count to be
expected, so that a word seen once says little. A sentence's difference of cross-entropies per token says
how much better a subject explains it than the background does; it deals with the best subject if the
difference exceeds that subject's margin. A document has every subject with which at least the share
LEAST_SHARE of its sentences deal, provided that at least LEAST_WORDS different words speak for it.
The margins are calibrated, subject by subject, on all labelled documents, each scored by a model that has
not seen it: the documents fall into `Training.folds` parts, and each part has a model of the others.

Word models, background and scores cover all documents, the subject models and margins all labelled ones.
Grams are counted and models computed in Spark; the driver holds the hashes of the grams that are counted
in the corpus, and one model's kept grams at a time. Words with a smaller share than
`Training.word_share` of a language's words take no part in telling the language.

Defined results: null, empty and blank texts, and texts without a sentence, have no subject; a part of
fewer than four words without a closing mark is no sentence; labels of unknown documents or subjects are
ignored; a document labelled twice counts once; repeated rows are repeated by `subjects`, not by
`accepted`; without any labels there are no subjects; any number of subjects may be given.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.language import LANGUAGES, named
from siltstone.session import discard, small, written

#: where a sentence ends; a line end is put behind it, since looking behind each white space takes far longer
SENTENCE_END = r"([.!?…][\"'”’»)]*)\s+"
LEAST_SHARE, LEAST_WORDS = 0.25, 2
#: documents counted or scored at a time, and numbers of a table of counts that are computed with at a time
ROWS, NUMBERS = 1_000, 1_000_000


@dataclass(frozen=True)
class Training:
    #: parts of the labelled documents, each of which calibrates by a model of the others
    folds: int = 5
    least_count: int = 3
    #: expected counts at which what was counted weighs as much as the model below it
    single: float = 1.0
    pair: float = 1.5
    #: a gram is kept if some subject has it so many standard deviations above what is to be expected, and
    #: speaks for a subject from this difference on
    significant: float = 2.0
    speaks: float = 0.5
    margins: tuple[float, ...] = (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3)
    #: the margin of subjects without labelled documents
    usual: float = 0.1
    #: words with at least this share of a language's words make its word model
    word_share: float = 2e-5


def cut(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, text's sentences as arrays of hashed words), as a written table."""

    def words(s):
        found = F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.xxhash64(w))
        return F.struct(found.alias("words"), F.rtrim(s).rlike(r"[.!?…][\"'”’»)]*$").alias("closed"))

    parts = F.transform(F.split(F.regexp_replace("text", SENTENCE_END, "$1\n"), r"\n+"), words)
    whole = F.filter(parts, lambda p: (F.size(p["words"]) >= 4) | (p["closed"] & (F.size(p["words"]) > 0)))
    found = F.coalesce(F.transform(whole, lambda p: p["words"]), F.array().cast("array<array<bigint>>"))
    return written(documents.select("doc_id", named(F.col("lang")).alias("lang"), found.alias("sentences")))


def _slices(it: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for at in range(0, len(whole), rows):
            yield whole.slice(at, rows)


def word_models(texts: DataFrame, t: Training = Training()) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each language's common words, and their log probabilities by language, counted
    over all texts that carry a label."""
    words = texts.where("lang is not null").select("lang", F.explode(F.flatten("sentences")).alias("word"))
    counted = written(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.lit(5.0)
    for lang, n in totals.items():
        # at most 1 / word_share words of a language reach the driver
        least = F.when(F.col("lang") == lang, max(5.0, t.word_share * n)).otherwise(least)
    rows = counted.where(F.col("n") >= least).collect()
    discard(counted)
    words_ = np.unique(np.array([r.word for r in rows], np.int64))
    logs = np.full((len(words_) + 1, len(LANGUAGES)), np.log(1e-6), np.float32)
    for r in rows:
        logs[np.searchsorted(words_, r.word), LANGUAGES.index(r.lang)] = np.log(r.n / totals[r.lang] + 1e-6)
    logs[-1] = 0
    return words_, logs


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted value in the sorted keys, len(keys) if it isn't there."""
    at = np.searchsorted(keys, wanted)
    hit = keys[np.minimum(at, max(len(keys) - 1, 0))] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return np.where(hit, at, len(keys))


class Tokens:
    """The tokens of a batch as flat arrays: word, sentence, and each sentence's document and language."""

    def __init__(self, sentences: pa.Array, models: tuple[np.ndarray, np.ndarray]):
        inner = sentences.flatten()
        self.document = pc.list_parent_indices(sentences).to_numpy().astype(np.int64)
        self.sentence = pc.list_parent_indices(inner).to_numpy().astype(np.int64)
        self.word = inner.flatten().to_numpy()
        self.count = np.bincount(self.sentence, minlength=len(self.document))
        words, logs = models
        at = _find(words, self.word)
        sums = np.stack([np.bincount(self.sentence, logs[at, k], len(self.document)) for k in range(len(LANGUAGES))], 1)
        self.lang = sums.argmax(1) if len(sums) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            mixed = _mix(self.word) + self.lang[self.sentence] * np.int64(0x2545F4914F6CDD1D)
            self.single = _mix(mixed)
            self.follows = np.r_[False, self.sentence[1:] == self.sentence[:-1]] if len(self.word) else np.zeros(0, bool)
            before = np.r_[np.int64(0), mixed[:-1]] if len(mixed) else mixed
            self.before = np.r_[np.int64(0), self.single[:-1]] if len(mixed) else mixed
            self.pair = np.where(self.follows, _mix(before * np.int64(31) + self.word), 0)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.int64(31))) * np.int64(-7046029254386353131)
        return x ^ (x >> np.int64(29))


def gram_counts(labelled: DataFrame, models: tuple[np.ndarray, np.ndarray], names: list[str]) -> DataFrame:
    """(gram, before, word, paired, lang, n, cells): counts of the words and word pairs of the labelled
    documents (sentences, subjects, fold), in cells (subject, fold, n); before and word are the grams of a
    pair's parts, and a word's own gram. A document of two subjects counts half for either."""
    shared = labelled.sparkSession.sparkContext.broadcast(models)
    number = {s: i for i, s in enumerate(names)}
    keys = ["gram", "before", "word", "paired", "lang", "subject", "fold"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            x = Tokens(b.column(0), shared.value)
            subjects = [[number[s] for s in of] for of in b.column(1).to_pylist()]
            doc, fold = x.document[x.sentence], np.array(b.column(2).to_pylist(), np.int32)
            lang = x.lang[x.sentence].astype(np.int32)
            none = np.zeros(len(doc), bool)
            both = {
                "gram": np.r_[x.single, x.pair], "before": np.r_[x.single, x.before], "word": np.r_[x.single, x.single], "paired": np.r_[none, ~none],
                "lang": np.r_[lang, lang], "doc": np.r_[doc, doc],
            }
            keep = np.r_[~none, x.follows]
            # once for each of a document's subjects
            for k in range(max(map(len, subjects), default=0)):
                of = np.array([s[k] if len(s) > k else -1 for s in subjects], np.int32)
                weight = np.array([1 / max(1, len(s)) for s in subjects])
                at = np.flatnonzero(keep & (of[both["doc"]] >= 0))
                d = both["doc"][at]
                table = pa.table({n: both[n][at] for n in ("gram", "before", "word", "paired", "lang")} | {"subject": of[d], "fold": fold[d], "n": weight[d]})
                yield from table.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).to_batches()

    rows = labelled.select("sentences", "subjects", "fold").mapInArrow(
        batches, "gram bigint, before bigint, word bigint, paired boolean, lang int, subject int, fold int, n double",
    )
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).groupBy("gram").agg(
        *(F.first(c).alias(c) for c in ("before", "word", "paired", "lang")), F.sum("n").alias("n"), F.collect_list(F.struct("subject", "fold", "n")).alias("cells"),
    )


def background(texts: DataFrame, models: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(gram, corpus): counts of the grams (sorted) in the whole corpus, as a written table that has null
    grams, too; and the corpus's tokens by language."""
    shared = texts.sparkSession.sparkContext.broadcast((models, grams))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, grams = shared.value
        counts, totals = np.zeros(len(grams) + 1, np.int64), np.zeros(len(LANGUAGES), np.int64)
        for b in _slices(it):
            x = Tokens(b.column(0), models)
            for keys in (x.single, x.pair[x.follows]):
                at, n = np.unique(_find(grams, keys), return_counts=True)
                counts[at] += n
            totals += np.bincount(x.lang, x.count, len(totals)).astype(np.int64)
        names, used = ["gram", "lang", "corpus"], np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(totals), pa.int64()), pa.array(np.arange(len(totals), dtype=np.int32)), pa.array(totals)], names)
        for i in range(0, len(used), NUMBERS):
            at = used[i : i + NUMBERS]
            yield pa.RecordBatch.from_arrays([pa.array(grams[at]), pa.nulls(len(at), pa.int32()), pa.array(counts[at])], names)

    counted = written(texts.select("sentences").mapInArrow(batches, "gram bigint, lang int, corpus bigint").groupBy("gram", "lang").agg(F.sum("corpus").alias("corpus")))
    shared.destroy()
    tokens = np.zeros(len(LANGUAGES))
    for r in counted.where("gram is null").collect():
        tokens[r.lang] = r.corpus
    return counted, tokens


def _dense(cells: pa.Array, folds: int, subjects: int) -> np.ndarray:
    """Cells of gram_counts as (folds, grams, subjects)."""
    out, inner = np.zeros((folds, len(cells), subjects)), cells.flatten()
    at = inner.field("fold").to_numpy(), pc.list_parent_indices(cells).to_numpy(), inner.field("subject").to_numpy()
    np.add.at(out, at, inner.field("n").to_numpy())
    return out


def vectors(grams: DataFrame, corpus: DataFrame, tokens: np.ndarray, names: list[str], t: Training) -> DataFrame:
    """(without, gram, vector): logarithms of how much more often each subject has a gram than is to be
    expected, by the model of all labelled documents (without -1) and by each that leaves a fold out.
    grams, corpus, tokens as of gram_counts (a written table) and background."""
    counted = written(grams.join(corpus.where("gram is not null").select("gram", "corpus"), "gram", "left").na.fill(0, ["corpus"]))
    singles = counted.where("not paired")
    sizes = np.zeros((t.folds, len(LANGUAGES), len(names)))
    # one row a language, subject and fold
    for r in singles.select("lang", F.inline("cells")).groupBy("lang", "subject", "fold").agg(F.sum("n").alias("n")).collect():
        sizes[r.fold, r.lang, r.subject] = r.n

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it, max(1, NUMBERS // (t.folds * len(names)))):
            gram, paired, lang, n, n_before, n_word = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            each = [_dense(b.column(i), t.folds, len(names)) for i in (6, 7, 8)]
            share = np.maximum(n_word, 0.5) / np.maximum(tokens[lang], 1)
            # what the corpus makes of a pair's second word after the first
            base = (n + t.pair * share) / (n_before + t.pair)
            for without in range(-1, t.folds):
                counts, before, word, size = (x.sum(0) - (x[without] if without >= 0 else 0) for x in (*each, sizes))
                expected = size[lang] * share[:, None]
                ratio = (word + t.single) / (expected + t.single)
                # of a pair: what the corpus, and then each subject, makes of it
                of_pair = before * base[:, None]
                ratio = np.where(paired[:, None], (counts + t.pair * ratio) / (of_pair + t.pair), ratio)
                expected = np.where(paired[:, None], of_pair, expected)
                # pruning: what no subject has far more often than is to be expected is left to the background
                logs = np.log(ratio)
                kept = np.flatnonzero(((counts - expected >= t.significant * np.sqrt(expected + 1)) & (logs >= t.speaks)).any(1))
                ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * np.int32(len(names)))
                logs = pa.ListArray.from_arrays(ends, pa.array(logs[kept].astype(np.float32).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), without, np.int32)), pa.array(gram[kept]), logs], ["without", "gram", "vector"])

    # a word's own gram is its `before` and `word`
    rows = counted
    for part in ("before", "word"):
        rows = rows.join(singles.select(F.col("gram").alias(part), F.col("corpus").alias(f"{part}_corpus"), F.col("cells").alias(f"{part}_cells")), part)
    rows = rows.select("gram", "paired", "lang", "corpus", "before_corpus", "word_corpus", "cells", "before_cells", "word_cells")
    out = written(rows.mapInArrow(batches, "without int, gram bigint, vector array<float>"))
    discard(counted)
    return out


class Model:
    """Differences of cross-entropies of words and word pairs; rows of one table of vectors."""

    def __init__(self, models: tuple[np.ndarray, np.ndarray], rows: pa.Table, names: list[str], t: Training):
        """rows: `gram` and `vector` of one model of `vectors`."""
        self.models, self.names, self.t = models, names, t
        self.margins = np.full(len(names), t.usual)
        gram = rows["gram"].to_numpy()
        order = np.argsort(gram)
        self.keys = gram[order]
        self.vectors = np.zeros((len(gram) + 1, len(names)), np.float32)
        self.vectors[:-1] = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, len(names))[order]

    def scores(self, sentences: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """(tokens, row of vectors of each, difference per token of each sentence and subject)."""
        x = Tokens(sentences, self.models)
        rows = _find(self.keys, x.single)
        pairs = _find(self.keys, x.pair)
        rows = np.where(x.follows & (pairs < len(self.keys)), pairs, rows)
        heavy = np.flatnonzero(rows < len(self.keys))
        out = np.stack([np.bincount(x.sentence[heavy], self.vectors[rows[heavy], s], len(x.document)) for s in range(len(self.names))], 1)
        return x, rows, out / np.maximum(x.count, 1)[:, None]

    def read(self, sentences: pa.Array) -> tuple[np.ndarray, ...]:
        """Of each sentence its document, best subject and difference; of each different word that speaks
        for the best subject of a sentence its document, subject and the greatest difference of these."""
        x, rows, d = self.scores(sentences)
        best = d.argmax(1) if len(d) else np.zeros(0, np.int64)
        most = d[np.arange(len(d)), best]
        subject = best[x.sentence]
        at = np.flatnonzero(self.vectors[rows, subject] > self.t.speaks)
        doc, subject, word, of = x.document[x.sentence[at]], subject[at], x.word[at], most[x.sentence[at]]
        order = np.lexsort((-of, word, subject, doc))
        doc, subject, word, of = doc[order], subject[order], word[order], of[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (subject[1:] != subject[:-1]) | (word[1:] != word[:-1])
        return x.document, best, most, doc[new], subject[new], of[new]

    def shares(self, n: int, read: tuple[np.ndarray, ...], margins: np.ndarray | None = None) -> np.ndarray:
        """(documents, subjects): the share of sentences that deal with each subject, 0 where fewer than
        LEAST_WORDS different words speak for it."""
        document, best, most, doc, subject, of = read
        margins = self.margins if margins is None else margins
        count = lambda d, s: np.bincount(d * len(self.names) + s, minlength=n * len(self.names)).reshape(n, -1)
        sure, speaks = most > margins[best], of > margins[subject]
        counts, words = count(document[sure], best[sure]), count(doc[speaks], subject[speaks])
        total = np.bincount(document, minlength=n)
        return np.where(words >= LEAST_WORDS, counts / np.maximum(total, 1)[:, None], 0.0)


def calibrated(models: Iterable[Model], labelled: DataFrame, t: Training) -> np.ndarray:
    """Of each subject, the margin with the best F1 over the labelled documents (sentences, subjects, fold),
    which are scored where they lie, those of each fold by the model that leaves it out."""
    found = 0
    for fold, model in enumerate(models):
        found = found + _tried(model, labelled.where(F.col("fold") == fold), t)
    # a subject's own documents count, and those of all subjects, since a subject may have few
    each = lambda x: 2 * x[..., 0] / np.maximum(1, x[..., 1] + x[..., 2])
    f1, truth = each(found) + each(found.sum(1))[:, None], found[0, :, 2]
    # of equally good margins the middle one
    best = [np.flatnonzero(f1[:, s] >= f1[:, s].max() - 1e-9) for s in range(len(truth))]
    chosen = np.array([t.margins[b[len(b) // 2]] for b in best])
    return np.where(truth > 0, chosen, t.usual)


def _tried(model: Model, labelled: DataFrame, t: Training) -> np.ndarray:
    """(margins, subjects, 3): documents of which a subject is said rightly, said, and true."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    names = model.names

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(t.margins), len(names), 3), np.int64)
        for b in _slices(it):
            truth = np.array([[n in of for n in names] for of in b.column(1).to_pylist()], bool).reshape(-1, len(names))
            read = shared.value.read(b.column(0))
            for i, m in enumerate(t.margins):
                said = shared.value.shares(len(b), read, np.full(len(names), m)) >= LEAST_SHARE
                total[i] += np.stack([(said & truth).sum(0), said.sum(0), truth.sum(0)], 1)
        i, s = (x.reshape(-1).astype(np.int32) for x in np.indices(total.shape[:2]))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), *(pa.array(total[:, :, k].reshape(-1)) for k in range(3))], ["margin", "subject", "both", "said", "true"])

    rows = labelled.select("sentences", "subjects").mapInArrow(batches, "margin int, subject int, both bigint, said bigint, true bigint")
    found = np.zeros((len(t.margins), len(names), 3))
    for r in rows.groupBy("margin", "subject").agg(*(F.sum(c).alias(c) for c in ("both", "said", "true"))).collect():
        found[r.margin, r.subject] = r.both, r.said, r.true
    shared.destroy()
    return found


def fit(texts: DataFrame, labels: DataFrame, names: list[str], t: Training = Training()) -> Model:
    """The model of all labelled documents, its margins calibrated on all of them by models that leave
    their folds out. texts is the table of `cut`."""
    models = word_models(texts, t)
    given = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    fold = F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(t.folds)).cast("int")
    # where there are few labels, only texts that have one move
    labelled = written(texts.join(small(given), "doc_id").groupBy(F.col("doc_id").alias("key")).agg(
        F.first("sentences").alias("sentences"), F.first("subjects").alias("subjects"), F.first(fold).alias("fold"),
    ))
    grams = written(gram_counts(labelled, models, names).where(F.col("n") >= t.least_count))
    # eight bytes a gram
    listed = np.sort(grams.select("gram").toArrow()["gram"].to_numpy())
    corpus, tokens = background(texts, models, listed)
    rows = vectors(grams, corpus, tokens, names, t)
    of = lambda without: Model(models, rows.where(F.col("without") == without).select("gram", "vector").toArrow(), names, t)
    model = of(-1)
    if len(listed):
        model.margins = calibrated((of(k) for k in range(t.folds)), labelled, t)
    discard(grams, corpus, rows, labelled)
    return model


def subjects(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, share, sentences) of each subject with which any sentence deals."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.names, object)
        for b in _slices(it):
            shares = m.shares(len(b), m.read(b.column(1)))
            d, s = np.nonzero(shares)
            n = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(d)), pa.array(names[s], pa.string()), pa.array(shares[d, s]), pa.array(n[d])],
                ["doc_id", "subject", "share", "sentences"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "sentences").mapInArrow(batches, f"doc_id {kind}, subject string, share double, sentences bigint")


def accepted(documents: DataFrame, labels: DataFrame, names: DataFrame, t: Training = Training()) -> DataFrame:
    """Distinct (doc_id, subject, share) of the subjects that each document has. The subjects are a
    given list, read on the driver."""
    given = sorted(r[0] for r in names.select("subject").where("subject is not null").distinct().collect())
    if not given:
        return documents.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share")).where("false")
    texts = cut(documents)
    found = subjects(texts, fit(texts, labels, given, t))
    return found.where(F.col("share") >= LEAST_SHARE).select("doc_id", "subject", "share")
