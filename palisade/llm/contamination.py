"""Benchmark decontamination through a positional inverted index of the training texts, in DataFrame operations only.

Only terms that the test items use are counted, and only each test window's rarest one is looked up. A posting keeps its
position and its neighbourhood, so the other terms' offset-adjusted positions are compared where the posting lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import text_of
from palisade.llm.lines import lowered
from palisade.session import materialize

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A lookup side is broadcast up to this many rows (windows have at most `words` terms each), joined by shuffle beyond.
BROADCAST_ROWS = 50_000


def terms(text: Column) -> Column:
    """Lower-cased words: digits, letters and everything beyond ASCII."""
    clean = F.trim(F.regexp_replace(lowered(text), BETWEEN, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def small(stored: DataFrame) -> DataFrame:
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def test_windows(benchmark: DataFrame, words: int) -> DataFrame:
    """item_id, seq: each run of so many words of an item; an item with fewer, but some, is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), terms(text_of()).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (words - 1)))
    runs = items.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at"))
    return runs.select("item_id", F.slice("w", F.col("at"), words).alias("seq")).distinct()


def training_terms(docs: DataFrame) -> DataFrame:
    """doc, text_hash, w: the positional form of every text, written once."""
    rows = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64(text_of()).alias("text_hash"), terms(text_of()).alias("w")
    )
    return materialize(rows, "training-terms")


def with_rarest(windows: DataFrame, trained: DataFrame) -> DataFrame:
    """Windows whose every term occurs in training, with their rarest term and its offset."""
    vocabulary = materialize(windows.select(F.explode("seq").alias("term")).distinct(), "vocabulary")
    seen = trained.select(F.explode("w").alias("term")).join(small(vocabulary), "term")
    counts = materialize(seen.groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    found = windows.select("item_id", "seq", F.posexplode("seq").alias("off", "term")).join(counts, "term")
    rarest = found.groupBy("item_id", "seq").agg(
        F.count("*").alias("known"), F.min(F.struct("n", "off", "term")).alias("least")
    )
    rarest = rarest.where(F.col("known") == F.size("seq"))
    return materialize(rarest.select("item_id", "seq", F.col("least.off").alias("off"), F.col("least.term").alias("term")), "windows")


def matches(trained: DataFrame, benchmark: DataFrame, words: int = 10, near: bool = False) -> DataFrame:
    """doc, text_hash, item_id, start, n: every place of a test window in a training text.

    With near, also places where all of the window's terms stand within words - 1 of its rarest one, in any order;
    kind says phrase or near, and start and n then give the searched neighbourhood.
    """
    windows = with_rarest(test_windows(benchmark, words), trained)
    wanted = materialize(windows.select("term").distinct(), "rare-terms")
    reach = words - 1
    postings = trained.select("doc", "text_hash", "w", F.posexplode("w").alias("pos", "term")).join(small(wanted), "term")
    first = F.greatest(F.lit(0), F.col("pos") - reach)
    around = F.slice("w", first + 1, F.least(F.col("pos"), F.lit(reach)) + words)
    index = materialize(postings.select("term", "doc", "text_hash", "pos", first.alias("first"), around.alias("around")), "postings")
    tried = index.join(small(windows), "term").withColumn("start", F.col("pos") - F.col("off"))
    inside = F.col("start") >= F.col("first")
    at = F.greatest(F.lit(1), F.col("start") - F.col("first") + 1)
    phrase = inside & (F.slice("around", at, F.size("seq")) == F.col("seq"))
    rows = tried.withColumn("kind", F.when(phrase, F.lit("phrase")))
    if near:
        close = F.size(F.array_except("seq", "around")) == 0
        rows = rows.withColumn("kind", F.coalesce("kind", F.when(close, F.lit("near"))))
    exact = F.col("kind") == "phrase"
    return rows.where("kind is not null").select(
        "doc", "text_hash", "item_id", "kind",
        F.when(exact, F.col("start")).otherwise(F.col("first")).alias("start"),
        F.when(exact, F.size("seq")).otherwise(F.size("around")).alias("n"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 10) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit (words inside any window's place), items (sorted item ids) of every row.

    Null and wordless texts have no words and no hits; rows with the same doc_id and text get the same result; items
    without words are no windows; an empty benchmark hits nothing; other columns are not read.
    """
    trained = training_terms(docs)
    found = matches(trained, benchmark, words)
    places = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place")
    hits = found.select("doc", "text_hash", "start", "n").distinct().select("doc", "text_hash", places)
    hits = hits.groupBy("doc", "text_hash").agg(F.size(F.collect_set("place")).cast("long").alias("n_hit"))
    items = found.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = trained.select("doc", "text_hash", F.size("w").cast("long").alias("n_words"))
    for table in (hits, items):
        table = table.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"})
        same = rows["doc"].eqNullSafe(table["_doc"]) & (rows["text_hash"] == table["_hash"])
        rows = rows.join(table, same, "left").drop("_doc", "_hash")
    return rows.select(
        F.col("doc").alias("doc_id"), "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
