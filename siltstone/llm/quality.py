"""Statistics of each document's text and lists, and fixed thresholds with a reason for each failure.

All statistics are native column expressions over the lines of the whole text: one pass that sums
per-line features, no shuffle. The thresholds are those published for web corpora (word count, mean
word length, symbols to words, bullet and ellipsis lines, alphabetic words, stop words, closing marks,
short lines), and one more: more than half of the words, or of the visible characters, stand in lines
that read as no sentence. A line reads as a sentence by its marks, its length and the function words of
published stop-word lists; a closed line of ordinary words does so in languages without a list, too.

A page is no prose if it fails that rule, or if it fails the rules of three published statistics and
at least two fifths of its words stand in no sentence. Short messages and filler are neither.

Defined results: a null or blank text has 0 words and rates of 0, and fails only "too_few_words"; null
lists count as empty; repeated rows are repeated; other columns, of whatever name, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.urls import let
from siltstone.llm import phrases


# a word that ties clauses in one language and noun phrases in another counts as the latter
NOMINAL_WORDS = {w for words in phrases.NOMINAL.values() for w in words.split()}
CLAUSAL_WORDS = {w for words in phrases.CLAUSAL.values() for w in words.split()} - NOMINAL_WORDS
MESSAGE = f"{phrases.ERRORS}|{phrases.SCRIPTS}"
MESSAGE_WORDS = 20
CLOSING = r"[.!?…。！？][\"'”’»)\]]*$"
BULLET = r"^\s*(?:[-*•‣▪◦·»–]|\d{1,3}[.)])\s"
#: letters of scripts that put no space between words
UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"
#: a word that begins as common words do; scripts without case always
COMMON_CASE = r"^[^\p{L}]*[\p{Ll}\p{Lo}]"
OPENING = r"^[^\p{L}\p{N}]*[\p{Lu}\p{Lt}\p{Lo}]"


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_words: int = 100_000
    mean_word: tuple[float, float] = (3.0, 10.0)
    symbols: float = 0.1
    bullets: float = 0.9
    ellipses: float = 0.3
    alphabetic: float = 0.8
    stop_words: int = 2
    closing: float = 0.12
    short_lines: float = 0.67
    short_line: int = 30
    no_sentence: float = 0.5
    #: a title alone is no list, table or rubbish: so many words or visible characters are
    least_no_sentence: int = 12
    least_visible: int = 150
    #: failures of published rules that count as well, from this share of words in no sentence on
    published: int = 3
    doubtful: float = 0.4


def is_filler(low: Column, runs: Column) -> Column:
    """Filler words among a lower-case line's words, or marks of unfilled templates; the costly pattern runs
    only where it can match."""
    can = low.rlike(r"[{}\[\]@#%|_*<>]")
    for word in ("undefined", "xxx-", "sample text", "goes here", "todo:"):
        can = can | F.contains(low, F.lit(word))
    return F.exists(runs, lambda w: w.isin(*phrases.FILLER_WORDS.split())) | (can & low.rlike(f"(?i){phrases.UNFILLED}"))


def word_total(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))


def _features(line: Column, more: bool) -> Column:
    """Words and runs of letters are cut once; sets of words are searched by hash, so that a word costs the
    same however many there are; costly patterns run only where they can decide."""
    size = lambda words, keep: F.size(F.filter(words, keep))

    def features(x: Column) -> Column:
        low, words, runs = x["low"], x["words"], x["runs"]
        closed = F.rtrim(line).rlike(CLOSING)
        kind = F.struct(
            F.size(words).alias("words"),
            F.length(F.array_join(runs, "")).alias("letters"),
            F.length(F.array_join(words, "")).alias("visible"),
            size(runs, lambda w: w.isin(*NOMINAL_WORDS)).alias("nominal"),
            size(runs, lambda w: w.isin(*CLAUSAL_WORDS)).alias("clausal"),
            F.when(closed, size(words, lambda w: w.rlike(COMMON_CASE))).otherwise(0).alias("lower"),
            (closed & line.rlike(OPENING) & ~line.rlike(r"[:;/|=\d]")).alias("whole"),
            F.when(F.octet_length(line) > 2 * F.length(line), F.length(F.regexp_replace(line, UNSPACED, ""))).otherwise(0).alias("unspaced"),
            closed.alias("closed"),
            is_filler(low, runs).alias("filler"),
            F.when(F.size(words) <= MESSAGE_WORDS, low.rlike(MESSAGE)).otherwise(F.lit(False)).alias("message"),
        )
        if not more:
            return kind
        rest = F.struct(
            size(words, lambda w: w.rlike(r"\p{L}")).alias("alphabetic"),
            F.regexp_count(line, F.lit(r"#|…|\.\.\.")).alias("symbols"),
            F.length(line).alias("size"),
            line.rlike(BULLET).alias("bullet"),
            F.rtrim(line).rlike(r"(?:…|\.\.\.)$").alias("ellipsis"),
        )
        return F.struct(kind.alias("k"), rest.alias("m"))

    cut = lambda low: F.struct(low.alias("low"), F.split(low, r"[^\p{L}]+").alias("runs"), F.filter(F.split(line, r"\s+"), lambda w: w != "").alias("words"))
    return let(let(F.lower(line), cut), features)


def kind_features(line: Column) -> Column:
    """What `line_kind` needs of a line."""
    return _features(line, False)


def line_features(line: Column) -> Column:
    """`kind_features` and what the published statistics need of a line, in one struct."""
    return _features(line, True)


def line_kind(f: Column) -> Column:
    """'sentence', 'filler', 'message' or 'other' of a line's `kind_features`."""
    stops = f["nominal"] + f["clausal"]
    plain = (f["letters"] >= 0.7 * f["visible"]) & (f["visible"] <= 12 * f["words"])
    open_ = (f["words"] >= 5) & (f["clausal"] >= 1) & (stops >= 2) & (stops >= 0.12 * f["words"])
    closed = f["closed"] & (f["words"] >= 4) & (f["clausal"] >= 1)
    # without such a word, a line that begins and ends as sentences do and isn't built like an entry
    foreign = (f["words"] >= 6) & (f["lower"] >= 0.5 * f["words"]) & f["visible"].between(3 * f["words"], 9 * f["words"])
    closed = closed | (f["whole"] & (((f["words"] >= 4) & (f["nominal"] >= 1)) | foreign))
    unspaced = (f["unspaced"] >= 0.5 * f["letters"]) & ((f["unspaced"] >= 16) | ((f["unspaced"] >= 6) & f["closed"]))
    sentence = (plain & (open_ | closed)) | unspaced
    return F.when(f["filler"], "filler").when(f["message"], "message").when(sentence, "sentence").otherwise("other")


SUMS = ("lines", "words", "letters", "visible", "stops", "alphabetic", "symbols", "closed", "bullet", "ellipsis", "short", "other_words", "other_visible")


def _list_words(entries: str) -> Column:
    return F.aggregate(F.coalesce(entries, F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda n, e: n + word_total(F.coalesce(e, F.lit(""))))


def statistics(df: DataFrame, key: str = "page_id", text: str = "main_text", paragraphs: str = "paragraphs", items: str = "list_items", r: Rules = Rules()) -> DataFrame:
    """One row of statistics per row, with `failures`, the names of the rules that it fails."""
    features = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_features)
    full = F.filter(features, lambda f: f["k"]["words"] > 0)
    kinds = F.transform(full, lambda f: F.struct(f["k"].alias("k"), f["m"].alias("m"), line_kind(f["k"]).alias("kind")))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in SUMS))

    def add(a: Column, x: Column) -> Column:
        k, m = x["k"], x["m"]
        one = lambda c: F.when(c, 1).otherwise(0)
        other = x["kind"] == "other"
        each = {n: k[n] for n in ("words", "letters", "visible")} | {n: m[n] for n in ("alphabetic", "symbols")}
        each |= {
            "lines": F.lit(1), "stops": k["nominal"] + k["clausal"], "closed": one(k["closed"]), "bullet": one(m["bullet"]),
            "ellipsis": one(m["ellipsis"]), "short": one(m["size"] <= r.short_line),
        }
        each |= {"other_words": F.when(other, k["words"]).otherwise(0), "other_visible": F.when(other, k["visible"]).otherwise(0)}
        return F.struct(*((a[n] + each[n]).cast("bigint").alias(n) for n in SUMS))

    # inline() keeps the optimiser from repeating the sums in each of the many columns read from them
    rows = df.select(
        key, F.inline(F.array(F.aggregate(kinds, zero, add))),
        F.coalesce(F.array_size(paragraphs), F.lit(0)).alias("n_paragraphs"), F.coalesce(F.array_size(items), F.lit(0)).alias("n_list_items"),
        _list_words(paragraphs).alias("paragraph_words"), _list_words(items).alias("list_words"),
    ).withColumnsRenamed({n: f"s_{n}" for n in SUMS})
    s = lambda n: F.col(f"s_{n}")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rates = {
        "mean_word_length": ("visible", "words"), "symbol_ratio": ("symbols", "words"), "letter_share": ("letters", "visible"), "alphabetic_share": ("alphabetic", "words"), "stop_share": ("stops", "words"), "closed_lines": ("closed", "lines"),
        "bullet_lines": ("bullet", "lines"), "ellipsis_lines": ("ellipsis", "lines"), "short_lines": ("short", "lines"), "no_sentence_share": ("other_words", "words"), "no_sentence_visible_share": ("other_visible", "visible"),
    }
    lists = rate(F.col("list_words"), F.col("list_words") + F.col("paragraph_words"))
    rows = rows.select(
        key, s("lines").alias("lines"), s("words").alias("words"), s("visible").alias("visible"), s("stops").alias("stop_words"), s("other_words").alias("no_sentence_words"), s("other_visible").alias("no_sentence_visible"),
        *(rate(s(a), s(b)).alias(n) for n, (a, b) in rates.items()), "n_paragraphs", "n_list_items", "paragraph_words", "list_words", lists.alias("list_share"),
    )
    failed = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in _published(r).items())))
    rows = rows.withColumn("failures", failed)
    return rows.withColumn("failures", F.when(no_sentences(r), F.array_append("failures", F.lit("no_sentences"))).otherwise(F.col("failures")))


def _published(r: Rules) -> dict[str, Column]:
    c, some = F.col, F.col("words") > 0
    return {
        "too_few_words": c("words") < r.least_words,
        "too_many_words": c("words") > r.most_words,
        "mean_word_length": some & ~c("mean_word_length").between(*r.mean_word),
        "symbols": c("symbol_ratio") > r.symbols,
        "bullets": c("bullet_lines") > r.bullets,
        "ellipses": c("ellipsis_lines") > r.ellipses,
        "not_alphabetic": some & (c("alphabetic_share") < r.alphabetic),
        "no_common_words": some & (c("stop_words") < r.stop_words),
        "no_closing_marks": some & (c("closed_lines") < r.closing),
        "short_lines": some & (c("short_lines") > r.short_lines),
    }


#: the published rules that speak of form; text length doesn't
FORM_RULES = ("mean_word_length", "symbols", "bullets", "ellipses", "not_alphabetic", "no_common_words", "no_closing_marks", "short_lines")


def no_sentences(r: Rules = Rules()) -> Column:
    c = F.col
    much = (c("no_sentence_words") >= r.least_no_sentence) | (c("no_sentence_visible") >= r.least_visible)
    mostly = (c("no_sentence_share") > r.no_sentence) | (c("no_sentence_visible_share") > r.no_sentence)
    formless = F.size(F.array_intersect("failures", F.array(*map(F.lit, FORM_RULES)))) >= r.published
    return much & (mostly | (formless & (c("no_sentence_share") > r.doubtful)))


def no_prose(df: DataFrame, key: str = "page_id", **columns: str) -> DataFrame:
    """(key) of the rows that fail the rule "no_sentences", on its own or with the published ones."""
    return statistics(df, key, **columns).where(F.array_contains("failures", "no_sentences")).select(key)
