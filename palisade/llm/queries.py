"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import collocations, contamination, hilbert, lines, mixing, nearcopies, personal, quality, repeats, tokens, toxicity, treap
from palisade.llm.common import documents
from palisade.llm.sql import COLLOCATIONS, CONTAMINATION, LINES, MIX, RANKED

QUERIES: dict = {}
ORACLE: dict[str, str] = {
    "op1_mix_curriculum": MIX,
    "op8_contamination": CONTAMINATION,
    "op10_line_runs": LINES,
    "op11_ranked_search": RANKED,
    "op13_collocations": COLLOCATIONS,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


@query
def op1_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    placed = mixing.mixed(docs)
    time = mixing.training_time(F.col("done"), F.col("target"), F.col("class"), mixing.SCHEDULES)
    time = F.when(F.col("taken") > 0, time)
    rows = placed.select("_row.doc_id", "size", "source_size", "target", "taken", time.alias("position"))
    return rows.orderBy("position", "doc_id")


@query
def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    rows = hilbert.sharded(docs, keep=["doc_id"])
    return rows.select(
        "_row.doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "index",
    )


@query
def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(documents(spark, sf_dir)).select(F.col("_id").alias("doc_id"), "class_id")


@query
def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeated_bytes(documents(spark, sf_dir)).withColumnRenamed("n_units", "n_bytes")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(documents(spark, sf_dir), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op6_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeated_words(documents(spark, sf_dir)).withColumnRenamed("n_units", "n_words")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", *quality.COUNTS, "base_failed", "kept", "log_perplexity"]
    return quality.judged(documents(spark, sf_dir)).select(*names)


@query
def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(documents(spark, sf_dir))
    counts = [f"n_{k}" for k in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return treap.ranked(documents(spark, sf_dir).select("doc_id", "text"), items)


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir)).drop("words")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
