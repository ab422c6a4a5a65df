"""What intermediate tables take on disk."""

import glob
import os

from pyspark.sql import functions as F

from palisade.session import materialize
from palisade.streaming.ledger import Ledger


def _bytes(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def _texts(spark):
    """Words without repeats of whole texts, as documents hold them."""
    words = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", i), F.lit(5000)).cast("string")))
    return spark.range(500).select("id", F.array_join(words, " ").alias("text"))


def test_stored_texts_take_less_than_by_the_default_codec(spark, tmp_path):
    rows = _texts(spark)
    rows.write.parquet(f"{tmp_path}/plain")
    stored = materialize(rows, "texts")
    assert sorted(stored.collect()) == sorted(rows.collect())
    assert _bytes(os.path.dirname(stored.inputFiles()[0].removeprefix("file:"))) < 0.8 * _bytes(f"{tmp_path}/plain")


def test_a_ledger_takes_less_than_by_the_default_codec(spark, tmp_path):
    rows = _texts(spark)
    rows.write.parquet(f"{tmp_path}/plain")
    stored = Ledger(spark, str(tmp_path)).write("chain", rows, 0)
    assert sorted(stored.collect()) == sorted(rows.collect())
    assert _bytes(f"{tmp_path}/chain") < 0.8 * _bytes(f"{tmp_path}/plain")
