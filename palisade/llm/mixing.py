"""Mixing sources to target weights along a curriculum whose weights change with time.

Every weight class has a schedule: knots (time, weight), linear in between, over times 0 to 1. A source's target is its
part of the budget by mean weight, stopped at a multiple of its size. Its demand up to time t is the target times the
schedule's integral up to t over the whole integral. A document that begins after c tokens of its source is trained on
at the time t whose demand is c: the integral inverted. Documents are then range-sorted by that time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import WORD, text_of, whole_rows
from palisade.session import checked_broadcast, materialize

Schedule = list[tuple[float, float]]
#: Sources in order take these in turn; their means are 5, 2 and 1.
SCHEDULES: list[Schedule] = [[(0.0, 6.0), (1.0, 4.0)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)]]
SLICE_ROWS = 20_000
#: The training times are cut into ranges of about so many rows, and into so few that the ranges of all sources stay a table to broadcast.
RANGE_ROWS = 2_000
MOST_RANGES = 50_000


def area(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def source_targets(sized: DataFrame, schedules: list[Schedule], share: float, times: int) -> DataFrame:
    """One row per source: source_size, rows, class (place in schedules), target. sized: _source, _size.

    Sources by code point, null last, take the schedules in turn. The level that fills share of all tokens is found
    over the sources ordered by limit over weight: those below it stop at their limit, the others get weight times level.
    Only sums per source meet in one task.
    """
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(area(s))) for s in schedules])
    ranked = sums.withColumn("class", (rank - 1) % len(schedules))
    ranked = ranked.withColumn("w", F.element_at(weights, F.col("class") + 1))
    ranked = ranked.withColumn("limit", (times * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("limit") / F.col("w"), F.col("_source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    filled = ranked.withColumn("place", F.row_number().over(by_level)).withColumn("level", left / open_weight)
    below = F.when(F.col("level") * F.col("w") < F.col("limit"), F.col("place"))
    level = F.min_by("level", below).over(everything)
    return filled.withColumn("target", F.coalesce(F.least("limit", level * F.col("w")), F.col("limit"))).select(
        "_source", "source_size", "rows", "class", "target"
    )


def training_time(done: Column, target: Column, kind: Column, schedules: list[Schedule]) -> Column:
    """The time at which a source's demand reaches done tokens: the inverse of its integrated schedule."""
    chosen = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        wanted = done / target * F.lit(area(schedule))
        time, below = F.lit(float(schedule[-1][0])), area(schedule)
        for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:]))):
            below -= (t1 - t0) * (w0 + w1) / 2
            rest, slope = wanted - F.lit(below), (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest))
            inside = F.lit(t0) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            time = F.when(wanted < F.lit(below + (t1 - t0) * (w0 + w1) / 2), inside).otherwise(time)
        chosen = F.when(kind == k, time).otherwise(chosen)
    return chosen


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Every row (_row) with _source, _size (its words) and _order, the hash that orders the documents of a source."""
    key = F.concat_ws("|", F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    return whole_rows(docs).select(
        "_row",
        F.col("_row.source").alias("_source"),
        F.regexp_count(text_of("_row.text"), F.lit(WORD)).cast("long").alias("_size"),
        F.md5(key).alias("_order"),
    )


def _with_slice(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The slice of a row: as many digits of _order as cut the source with the most rows into slices of SLICE_ROWS."""
    most = targets.agg(F.max("rows")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1.0, most / SLICE_ROWS), 16)))
    return sized.withColumn("_slice", F.substring("_order", 1, digits))


def _placed(sliced: DataFrame, targets: DataFrame, order: list[str]) -> DataFrame:
    """Rows with _done, the tokens of their source before them, and the facts of their source."""
    parts = ["_source", "_slice"]
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*parts).agg(F.sum("_size").alias("n"))
    slices = slices.select(*parts, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    facts = materialize(
        slices.join(targets, slices["_source"].eqNullSafe(targets["_source"])).drop(targets["_source"]), "slices"
    )
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumn("_upto", F.sum("_size").over(inside))
    placed = summed.alias("d").join(
        facts.alias("f"),
        F.col("d._source").eqNullSafe(F.col("f._source")) & (F.col("d._slice") == F.col("f._slice")),
    )
    placed = placed.withColumn("_done", F.col("_before") + F.col("_upto") - F.col("_size"))
    return placed.select("d.*", "_done", "source_size", "target", "class")


def mixed(
    docs: DataFrame, schedules: list[Schedule] = SCHEDULES, share: float = 1.5, times: int = 2, seed: int = 0
) -> DataFrame:
    """Every row (_row) with its place in the mix: size, source_size, target, done (tokens of its source before it),
    taken (tokens the mix takes, repeats counted), class.

    A source's documents stand in the order of md5(doc_id, seed), cut into slices of about SLICE_ROWS rows by that hash,
    so a source with most of the rows is summed in many tasks. The order is passed through times over until the target
    is met; the document that meets it is taken in part. Null texts have size 0 and are not taken; rows without doc_id
    come in any order among themselves; an empty table gives an empty result; other columns stay inside _row.
    """
    sized = _sized(docs, seed)
    targets = materialize(source_targets(sized.select("_source", "_size"), schedules, share, times), "targets")
    placed = _placed(_with_slice(sized, targets), targets, ["_order", "_size"])
    goal, zero = F.floor("target").cast("long"), F.lit(0).cast("long")
    taken = zero
    for again in range(times):
        gone = F.col("_done") + again * F.col("source_size")
        taken = taken + F.greatest(zero, F.least(F.col("_size"), goal - gone))
    return placed.select(
        "_row", F.col("_size").alias("size"), "source_size", "target", F.col("_done").alias("done"),
        taken.alias("taken"), F.col("class"),
    )


def training_order(
    docs: DataFrame, schedules: list[Schedule] = SCHEDULES, times: int = 2, share: float = 1.5, seed: int = 0
) -> DataFrame:
    """The mix itself: every whole document, once for each time it is taken, with its time, range-sorted by it.

    A document is given whole where the target is met inside it, so a source passes its target by less than one
    document. Columns: those of docs, in the order of the training times.

    Whole rows are shuffled once, to the range of their time. The places are found without the texts; for each slice,
    round and range a small table keeps the first and last place and the tokens before. A row goes to every range whose
    places enclose its own, where the sum is made again and the rows of other ranges go: rows alike up to a cut
    stay exact. Places are by _order, size and a hash of the whole row, so only rows equal in all columns share one.
    """
    at = F.struct("_order", "_size", F.xxhash64(F.to_json(F.col("_row").dropFields("text")), text_of("_row.text")).alias("_hash"))
    sized = _sized(docs, seed).withColumn("_at", at).drop("_order")
    bare = materialize(sized.select("_source", "_size", "_at"), "sizes").withColumn("_order", F.col("_at._order"))
    targets = materialize(source_targets(bare.select("_source", "_size"), schedules, share, times), "targets")
    sources, rows = targets.agg(F.count("*"), F.sum("rows")).first()
    ranges = max(1, min(math.ceil(times * (rows or 0) / RANGE_ROWS), MOST_RANGES // max(1, sources)))
    time = training_time(F.col("_done"), F.col("target"), F.col("class"), schedules)
    place = F.floor(time * ranges).cast("int")

    placed = _placed(_with_slice(bare, targets).where("_size > 0"), targets, ["_at"])
    placed = placed.withColumn("_first", F.min("_done").over(Window.partitionBy("_source", "_slice", "_at")))
    begun = placed.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    for c in ("_done", "_first"):
        begun = begun.withColumn(c, F.col(c) + F.col("_round") * F.col("source_size"))
    begun = begun.where(F.col("_done") < F.floor("target")).withColumn("_range", place)
    cuts = begun.groupBy("_source", "_slice", "_round", "_range", "target", "class").agg(
        F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.min("_first").alias("_before")
    )
    cuts = checked_broadcast(cuts)  # else the texts would be shuffled for it

    whole = _with_slice(sized.withColumn("_order", F.col("_at._order")), targets).drop("_order")
    met = F.col("d._source").eqNullSafe(F.col("c._source")) & (F.col("d._slice") == F.col("c._slice"))
    met = met & (F.col("_at") >= F.col("_low")) & (F.col("_at") <= F.col("_high"))
    sent = whole.alias("d").join(cuts.alias("c"), met)
    sent = sent.select("_row", "_at", "_size", "d._source", "d._slice", "_round", "_range", "_before", "target", "class")
    dealt = sent.repartitionByRange("_range")
    inside = Window.partitionBy("_range", "_source", "_slice", "_round").orderBy("_at")
    upto = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    dealt = dealt.withColumn("_done", F.col("_before") + upto - F.col("_size"))
    dealt = dealt.where((F.col("_size") > 0) & (F.col("_done") < F.floor("target")))
    dealt = dealt.withColumn("_time", time).where(place == F.col("_range"))
    return dealt.sortWithinPartitions("_time").select("_row.*")
