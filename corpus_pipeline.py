"""Documents to training shards, stage by stage: quality, near copies, contamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import contamination, hilbert, mixing, nearcopies, quality
from palisade.llm.common import documents, text_of, whole_rows
from palisade.session import materialize

SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near copies stays."""
    return nearcopies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark passage go."""
    found = contamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean = found.where("n_hit = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of("_row.text")) == F.col("_hash"))
    return whole_rows(docs).join(clean, same, "left_semi").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with shard and slot; columns of these names in the input give way."""
    rows = hilbert.sharded(docs, SHARDS)
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.select(*kept, "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The quality stage fits a language model and near-dedup verifies sketches; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
