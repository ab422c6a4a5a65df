"""Sharding along a Hilbert curve through the metadata, so that a shard covers a small box of every dimension.

Dimensions are quantised to the same number of bits: texts by the rank of their value, weighted by rows; numbers by a
fixed logarithmic scale. Rows are sorted by their index on the curve, and the sorted rows are cut into equal runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from palisade.llm.common import numbered, text_of, whole_rows
from palisade.session import checked_broadcast, new_path

BITS = 5
#: Bounds of up to so many runs are broadcast to prune by; more of them are joined by shuffle.
MOST_BROADCAST = 100_000


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of cells[dimension, row]: undo the rotations bit by bit, Gray-code, interleave."""
    x = [c.astype(np.int64) for c in cells]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            far = (x[i] & bit) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(far, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        bit >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[n - 1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    index = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ turn) >> b) & 1)
    return index


@F.pandas_udf(LongType())
def _index3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(curve_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()]), BITS))


def ranked_cells(df: DataFrame, column: str) -> DataFrame:
    """For each value of a column, the cell that holds its share of the rows in value order, null last.

    Only one row per distinct value meets in the window; meant for names such as sources or languages.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col(column).asc_nulls_last())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = F.floor(before * (1 << BITS) / F.sum("n").over(Window.partitionBy()))
    return counts.select(F.col(column).alias("_value"), cell.cast("long").alias("_cell"))


def size_cell(size: Column) -> Column:
    """Two cells for each doubling of the size, from 16 up."""
    return F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double")) * 2) - 8)).cast("long")


def sharded(
    docs: DataFrame, shards: int = 8, names: tuple[str, str] = ("source", "lang"), keep: list[str] | None = None
) -> DataFrame:
    """Every row (_row: all columns, or those in keep) with size, crc, index (on the curve), shard and slot (its place in the shard, from 0).

    Shards are runs of the curve whose row counts are at most one apart. Equal indexes are ordered by doc_id, then by
    the text's checksum and size; rows equal in all of these are alike. Null names form a value of their own, null
    texts have size 1 and checksum 0, missing name columns and an empty table are allowed, other columns stay in _row.
    """
    size = (F.octet_length(text_of("_row.text")) + 1).cast("long")
    rows = whole_rows(docs).select("_row", size.alias("size"), F.crc32(text_of("_row.text").cast("binary")).alias("crc"))
    cells = [size_cell(F.col("size"))]
    for i, name in enumerate(names):
        value = F.col(f"_row.{name}").cast("string") if name in docs.columns else F.lit(None).cast("string")
        rows = rows.withColumn(f"_v{i}", value)
        table = ranked_cells(rows, f"_v{i}").select(F.col("_value").alias(f"_t{i}"), F.col("_cell").alias(f"_c{i}"))
        table = checked_broadcast(table)  # else the texts would be shuffled for a table of names
        rows = rows.join(table, F.col(f"_v{i}").eqNullSafe(F.col(f"_t{i}")), "left").drop(f"_v{i}", f"_t{i}")
        cells.append(F.col(f"_c{i}"))
    rows = rows.withColumn("index", _index3(cells[1], cells[2], cells[0])).withColumn("_id0", F.col("_row.doc_id"))
    row = F.struct(*[F.col(f"_row.`{c}`") for c in keep]).alias("_row") if keep else "_row"
    rows = rows.select(row, "size", "crc", "index", "_id0")
    ranked, n = numbered(rows, ["index", "_id0", "crc", "size"])
    ranked = ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div {max(1, n)} as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_rank", "_id0")


class ShardFiles:
    """Rows stored along the curve: folders of shards, each cut into runs (numbered through), and the bounds of every run.

    A run holds a stretch of the curve, hence a small box of each dimension. Bounds are the least and largest value of
    every dimension in a run, texts compared by their bytes, and the number of nulls; one row per run, kept as a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        """All stored rows (_row: all columns of the input), with size, index, slot, shard and run."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bounds")

    def runs_for(self, ranges: dict[str, tuple]) -> DataFrame:
        """(shard, run) of the runs whose bounds meet every range (low, high), both ends included, None for open."""
        met = F.lit(True)
        for name, (low, high) in ranges.items():
            if low is not None:
                met = met & (F.col(f"max_{name}") >= F.lit(low))
            if high is not None:
                met = met & (F.col(f"min_{name}") <= F.lit(high))
        return self.bounds().where(met).select("shard", "run")

    def where(self, ranges: dict[str, tuple]) -> DataFrame:
        """The stored rows inside all ranges; only folders of runs whose bounds meet them are read.

        A null is inside no range. The runs are joined by the folders' column, so Spark prunes folders while it runs.
        """
        rows = self.rows()
        inside = F.lit(True)
        for name, (low, high) in ranges.items():
            value = F.col("size") if name == "size" else F.col(f"_row.{name}").cast("string")
            inside = inside & value.isNotNull()
            if low is not None:
                inside = inside & (value >= F.lit(low))
            if high is not None:
                inside = inside & (value <= F.lit(high))
        runs = self.runs_for(ranges).select("run")  # a plain filter of the bounds, which Spark can prune by
        if self.bounds().count() <= MOST_BROADCAST:
            runs = F.broadcast(runs)
        return rows.join(runs, "run", "left_semi").where(inside)


def store_shards(
    docs: DataFrame, path: str | None = None, shards: int = 8, runs: int = 16, names: tuple[str, str] = ("source", "lang")
) -> ShardFiles:
    """Write every row under shard and run folders (a shard's rows in runs of at most one row's difference).

    Name columns that the input lacks have no bounds. An empty table stores no rows and no bounds; nulls and repeated
    rows are stored like others.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    placed = sharded(docs, shards, names).drop("crc")
    ends = placed.groupBy("shard").agg(F.count("*").alias("_rows"))
    placed = placed.join(F.broadcast(ends), "shard")  # a row per shard
    placed = placed.withColumn("run", F.expr(f"cast(shard * {runs} + slot * {runs} div _rows as int)")).drop("_rows")
    cells = placed.repartition(F.col("shard"), F.col("run")).sortWithinPartitions("shard", "run", "slot")
    cells.write.partitionBy("shard", "run").parquet(f"{path}/rows")
    stored = ShardFiles(spark, path, placed.schema)
    kinds = {"size": F.col("size")}
    kinds |= {n: F.col(f"_row.{n}").cast("string") for n in names if n in docs.columns}
    bounds = []
    for name, value in kinds.items():
        bounds += [F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")]
        bounds += [F.count_if(value.isNull()).alias(f"nulls_{name}")]
    stored.rows().groupBy("shard", "run").agg(F.count("*").alias("n_rows"), *bounds).write.parquet(f"{path}/bounds")
    return stored
