"""Quality rules: counts of a text's words, symbols and repetitions, and a modified Kneser-Ney model of its spelling.

The model (ngrams.py) has a row for every 4-gram of the corpus. Texts outside their language's band of log perplexity are
rejected; every value of lang, null too, is a language of its own. A text's perplexity is the median over its passages, so
that a quotation or a number in good prose does not decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import ngrams
from palisade.llm.common import Rolling, Texts, chunks, mix, text_of
from palisade.session import checked_broadcast, materialize

#: Texts further than so many interquartile ranges from their language's middle half are rejected.
BAND = 3.5
SYMBOLS = b"#*$%&|<>"


def _lang_text(docs: DataFrame) -> tuple[Column, Column]:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return lang.alias("lang"), text_of().alias("text")


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    t = Texts(texts)
    words, n = t.words(), len(texts)
    letters = np.concatenate([[0], np.cumsum(((t.data & 0xC0) != 0x80) & ~np.isin(t.data, [32, 9, 10, 11, 12, 13]))])
    symbols = np.concatenate([[0], np.cumsum(np.isin(t.data, list(SYMBOLS)))])
    stop = np.flatnonzero(t.data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    full = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop = start[full], stop[full]
    doc = np.searchsorted(t.stop, start)
    return {
        "n_words": np.diff(words.first),
        "word_chars": letters[t.stop] - letters[t.start],
        "n_symbols": symbols[t.stop] - symbols[t.start],
        "n_dup_lines": np.bincount(doc, minlength=n) - _distinct(t, start, stop, doc, n),
        "n_repeat_words": _repeated_words(words, n),
    }


def _distinct(t: Texts, start: np.ndarray, stop: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    value = t.rolling().of(start, stop)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


def _repeated_words(words, n: int, size: int = 3) -> np.ndarray:
    at = np.arange(max(0, len(words.doc) - size + 1))
    at = at[words.doc[at] == words.doc[at + size - 1]] if len(at) else at
    value = mix(Rolling(words.hash).of(at, at + size) + words.doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + size, -1)
    return np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scores(docs: DataFrame, block: int = ngrams.BLOCK, wanted: int = ngrams.RANGE) -> DataFrame:
    """doc_id, text_hash, lang, the base counts and log_perplexity (null without characters) of every row."""
    lang, text = _lang_text(docs)
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), lang, text)
    rows = rows.withColumn("model", ngrams.model_name(F.col("lang"), ngrams.half(F.col("text_hash"))))

    def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
        parts = [base_counts(texts[begin:end]) for begin, end in chunks(texts)]
        return {name: np.concatenate([np.zeros(0, np.int64), *(p[name] for p in parts)]) for name in COUNTS}

    return ngrams.perplexities(rows, ngrams.fitted(rows), counts, COUNTS, block, wanted)


def judged(docs: DataFrame, band: float = BAND) -> DataFrame:
    """scores() with base_failed, low and high (the language's band) and kept.

    Bands are quartiles over all texts of a language that pass the base rules, widened by band times their distance. A
    null or empty text has no words and fails the base rules; rows alike in doc_id, lang and text get the same verdict;
    every value of lang is a language of its own, and so is null; an empty table gives an empty result; other columns
    are not read.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = materialize(scores(docs).withColumn("base_failed", failed), "quality")
    quarters = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), F.lit(2000))
    found = scored.where("not base_failed").groupBy(F.col("lang").alias("_lang")).agg(quarters.alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    table = checked_broadcast(found.select("_lang", (low - band * (high - low)).alias("low"), (high + band * (high - low)).alias("high")))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    placed = scored.join(table, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return placed.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    good = judged(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of("_row.text")) == F.col("_hash"))
    if "lang" in docs.columns:
        same = same & F.col("_row.lang").cast("string").eqNullSafe(F.col("_lang"))
    return rows.join(good, same, "left_semi").select("_row.*")
