"""Order-dependent operators per key that stay balanced when one key holds most of the rows.

A Spark window sorts all rows of a key in one task. That is the cheapest plan while every key is small, and the wrong
one for a hot key. `by_heat` counts the rows per key first (a map-side combined count over one column) and runs the same
steps twice: as windows per key for the cold keys, and over slices of the total order for the hot ones.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import checked_broadcast, inline_table, materialize

# A key with more rows than this is never given to a single task.
HOT_ROWS = 1_000_000
# Most rows per slice of a hot key's order; smaller slices, down to MIN_SLICE_ROWS, keep all tasks busy on small data.
# Slices grow instead of becoming more than MAX_SLICES, so that the table of per-slice carries has a fixed bound.
SLICE_ROWS = 250_000
MIN_SLICE_ROWS = 5_000
MAX_SLICES = 20_000
# Rows per partition of a total sort.
SORT_ROWS = 1_000_000

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number inside the partition below


def hot_keys(df: DataFrame, key: str, limit: int = HOT_ROWS) -> DataFrame:
    """Written table of the keys with more than `limit` rows; its size decides whether joins with it broadcast."""
    counts = df.groupBy(key).count().filter(F.col("count") > limit)
    return materialize(counts.select(key), "hot-keys")


def order_index(df: DataFrame, order: list[str], name: str = "pos", total: int | None = None) -> DataFrame:
    """Number the rows 0,1,2,... in the total order `order` without a single-task sort.

    Range partitioning samples the order columns, so a hot key is cut across many partitions. The sorted rows are written
    once; their numbers inside a partition are stored with them, and the driver only sums one row count per partition.
    The number of rows, `total`, sets the number of partitions.
    """
    spark = df.sparkSession
    total = df.count() if total is None else total
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SORT_ROWS))
    stored = materialize(
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ordered",
    )
    stored = stored.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    sizes = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    starts, before = [], 0
    for part, rows in sizes:
        starts.append((part, before))
        before += rows
    offsets = inline_table(spark, starts, "_part bigint, _before bigint")
    inside = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + inside)
        .drop("_mid", "_part", "_before")
    )


class KeyWindows:
    """Order-dependent columns as windows per key. All three share one exchange and one sort."""

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order
        self._window = Window.partitionBy(key).orderBy(*order)

    def running_count(self, df: DataFrame, name: str, counted: Column) -> DataFrame:
        """Running number of the counted rows of the key; null on the other rows."""
        upto = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("_counted", F.coalesce(counted, F.lit(False))).withColumn(
            name, F.when(F.col("_counted"), F.sum(F.col("_counted").cast("bigint")).over(upto))
        ).drop("_counted")

    def row_number(self, df: DataFrame, name: str) -> DataFrame:
        """Place of the row among those of its key, from 1."""
        return df.withColumn(name, F.row_number().over(self._window).cast("bigint"))

    def since_silence(self, df: DataFrame, name: str, seconds: str, ttl: float) -> DataFrame:
        """Rows of the key since its last silence of more than `ttl` seconds, the current row included."""
        gap = F.col(seconds) - F.lag(seconds).over(self._window)
        upto = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            df.withColumn("_fresh", gap.isNull() | (gap > ttl))
            .withColumn("_rn", F.row_number().over(self._window).cast("bigint"))
            .withColumn(name, F.col("_rn") - F.max(F.when(F.col("_fresh"), F.col("_rn"))).over(upto) + 1)
            .drop("_fresh", "_rn")
        )

    def trailing(self, df: DataFrame, name: str, value: Column, n: int) -> DataFrame:
        """Array of the last `n` values of the key up to the current row, oldest first."""
        past = [F.lag("_value", i).over(self._window) for i in range(n - 1, 0, -1)]
        return (
            df.withColumn("_value", value)
            .withColumn(name, F.array_compact(F.array(*past, F.col("_value"))))
            .drop("_value")
        )


class SlicedOrder:
    """The same columns over equal slices of the total order (key, order...): no task sees more than one slice.

    `prepare` numbers the rows once; what a slice must know about the rows before it is one value per slice, summed up at
    the driver, or one per slice and hot key, summed up in a written table.
    """

    def __init__(self, key: str | None, order: list[str]):
        self.key = key
        self.order = ([key] if key else []) + [c for c in order if c != key]
        self.size = SLICE_ROWS

    def prepare(self, df: DataFrame) -> DataFrame:
        total = df.count()
        rows = order_index(df, self.order, "_pos", total)
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        even = max(MIN_SLICE_ROWS, math.ceil(total / (4 * tasks)))
        self.size = max(min(SLICE_ROWS, even), math.ceil(total / MAX_SLICES))
        return rows

    def running_count(self, df: DataFrame, name: str, counted: Column) -> DataFrame:
        rows = df.withColumn("_counted", F.coalesce(counted, F.lit(False)).cast("bigint")).withColumn(
            "_slice", self._home()
        )
        sums = rows.groupBy("_slice", self.key).agg(F.sum("_counted").alias("n"))
        earlier = Window.partitionBy(self.key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = materialize(sums.select("_slice", self.key, F.sum("n").over(earlier).alias("_carry")), "carries")
        upto = (
            Window.partitionBy("_slice", self.key)
            .orderBy("_pos")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        total = F.sum("_counted").over(upto) + F.coalesce("_carry", F.lit(0))
        return (
            rows.join(carry, ["_slice", self.key], "left")
            .withColumn(name, F.when(F.col("_counted") == 1, total))
            .select(*df.columns, name)
        )

    def row_number(self, df: DataFrame, name: str) -> DataFrame:
        # a key's rows follow each other in the total order, so its first place is all that has to be known: no shuffle
        first = checked_broadcast(df.groupBy(self.key).agg(F.min("_pos").alias("_first")))
        return df.join(first, self.key).withColumn(name, F.col("_pos") - F.col("_first") + 1).select(*df.columns, name)

    def since_silence(self, df: DataFrame, name: str, seconds: str, ttl: float) -> DataFrame:
        rows, window = self._with_halo(df, 1)
        gap = F.col(seconds) - self._past(seconds, 1, window)
        marked = (
            rows.withColumn("_fresh", gap.isNull() | (gap > ttl))
            .filter("_slice = _home")
            .withColumn("_start", F.when(F.col("_fresh"), F.col("_pos")))
        )
        # the last start before a slice, from one row per slice
        last = marked.groupBy("_slice").agg(F.max("_start").alias("last")).orderBy("_slice").collect()
        carries, seen = [], None
        for number, start in last:
            carries.append((number, seen))
            seen = start if start is not None else seen
        carry = inline_table(df.sparkSession, carries, "_slice bigint, _carry bigint")
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            marked.withColumn("_start", F.max("_start").over(upto))
            .join(F.broadcast(carry), "_slice")
            .withColumn(name, F.col("_pos") - F.coalesce("_start", "_carry") + 1)
            .select(*df.columns, name)
        )

    def trailing(self, df: DataFrame, name: str, value: Column, n: int) -> DataFrame:
        rows, window = self._with_halo(df.withColumn("_value", value), n - 1)
        past = [self._past("_value", i, window) for i in range(n - 1, 0, -1)]
        return (
            rows.withColumn(name, F.array_compact(F.array(*past, F.col("_value"))))
            .filter("_slice = _home")
            .select(*df.columns, name)
        )

    def _home(self) -> Column:
        return F.floor(F.col("_pos") / self.size)

    def _past(self, column: str, back: int, window) -> Column:
        value = F.lag(column, back).over(window)
        return F.when(F.lag(self.key, back).over(window) == F.col(self.key), value) if self.key else value

    def _with_halo(self, df: DataFrame, reach: int):
        """Cut the order into equal slices and copy the last `reach` rows of each into the next one."""
        self.size = max(self.size, reach + 1)
        tail = F.col("_pos") % self.size >= self.size - reach
        rows = df.withColumn("_home", self._home()).withColumn(
            "_slice", F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
        )
        return rows, Window.partitionBy("_slice").orderBy("_pos")


def by_heat(
    df: DataFrame,
    key: str,
    order: list[str],
    steps: Callable[[DataFrame, KeyWindows | SlicedOrder], DataFrame],
    hot: DataFrame | list | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Apply `steps(rows, windows)` to the cold and the hot keys, each with the windows that fit. `key` is non-null.

    `hot` is a written table of the hot keys; an empty list says that there are none, without counting.
    """
    hot = hot_keys(df, key, limit) if hot is None else hot
    if isinstance(hot, list) or hot.isEmpty():
        return steps(df, KeyWindows(key, order))
    cold = steps(df.join(hot, key, "left_anti"), KeyWindows(key, order))
    slices = SlicedOrder(key, order)
    heat = steps(slices.prepare(df.join(hot, key, "left_semi")), slices)
    return cold.unionByName(heat.drop("_pos"))


def in_order(df: DataFrame, order: list[str], steps: Callable[[DataFrame, SlicedOrder], DataFrame]) -> DataFrame:
    """Apply `steps` over one total order of all rows."""
    slices = SlicedOrder(None, order)
    return steps(slices.prepare(df), slices).drop("_pos")
