"""Next-event prediction: back-off over the last events of an address, counted as plain aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.session import materialize

CONTEXT = 2
MIN_SUPPORT = 5
# Smallest probability that enters the log loss.
FLOOR = 1e-7
#: A context with at least this share of its length's events is hot: there are at most 1 / HOT_SHARE of a length.
HOT_SHARE = 0.005
#: Up to so many contexts the whole model is broadcast; beyond, only its hot ones are. The result is the same.
BROADCAST_CONTEXTS = 100_000


def transitions(recent: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Count (context, next event) for every context length up to `context`, from rows with `recent_events`.

    The count is combined map-side, so what is shuffled is the number of distinct contexts, not the number of events.
    """
    seq, n = F.col("recent_events"), F.size("recent_events")
    pairs = [
        F.when(
            n > k,
            F.struct(
                F.lit(k).alias("length"),
                F.slice(seq, n - k, F.lit(k)).alias("context"),
                F.element_at(seq, -1).alias("next_event"),
            ),
        )
        for k in range(context + 1)
    ]
    rows = recent.select(F.explode(F.array_compact(F.array(*pairs))).alias("p"))
    return rows.groupBy("p.length", "p.context", "p.next_event").agg(F.count(F.lit(1)).alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """P(next | context) of all contexts, with how often the context was seen and the most likely event marked."""
    totals = counts.groupBy("length", "context").agg(
        F.sum("n").alias("support"),
        F.min_by("next_event", F.struct(-F.col("n"), F.col("next_event"))).alias("predicted"),
    )
    return (
        counts.join(totals, ["length", "context"])
        .withColumn("probability", F.col("n") / F.col("support"))
        .withColumn("is_best", F.col("next_event") == F.col("predicted"))
        .drop("predicted")
    )


def fit(recent: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The model as a written table: its file size is what decides whether later joins broadcast it."""
    return materialize(probabilities(transitions(recent, context)), "next-event-model")


def _looked_up(rows: DataFrame, tier: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """rows with _p{k} of their context _c{k}, from tier (at most one row per context)."""
    key, value = f"_c{k}", f"_p{k}"
    contexts = model.filter("is_best").select(F.col("context").alias("_hot"), "support")
    least = contexts.agg(F.sum("support") * HOT_SHARE).scalar()
    often = contexts.filter(F.col("support") >= least).select("_hot")
    often = often.join(tier.withColumnRenamed(key, "_tier"), often["_hot"] == F.col("_tier"), "left").drop("_tier")
    rows = rows.join(F.broadcast(often.withColumnRenamed(value, "_often")), rows[key] == F.col("_hot"), "left")
    # hot rows, and rows without this context, get a key of their own that no context has
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    alone = F.array(F.lit("\0"), F.xxhash64("recent_events", *plain).cast("string"))
    rows = rows.withColumn(key, F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(alone))
    rows = rows.join(tier.withColumnRenamed(value, "_rest"), key, "left")
    return rows.withColumn(value, F.coalesce("_often", "_rest")).drop("_hot", "_often", "_rest")


def predict(recent: DataFrame, model: DataFrame, context: int = CONTEXT, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Add predicted_next_attack, confidence (4 decimals), probability and context_length from the longest
    context seen at least `min_support` times.

    A model beyond BROADCAST_CONTEXTS is joined by shuffle, but for its hot contexts, a bounded number: rows that end in
    one find it by broadcast and take no part in that join, so none of its keys holds more than a small share of the rows.
    """
    best = model.filter(F.col("is_best") & (F.col("support") >= min_support))
    seq, n = F.col("recent_events"), F.size("recent_events")
    small = model.filter("is_best").count() <= BROADCAST_CONTEXTS
    rows, tiers = recent, []
    for k in range(context, -1, -1):
        entry = F.struct(F.col("next_event").alias("event"), "probability", "length")
        tier = best.filter(F.col("length") == k).select(F.col("context").alias(f"_c{k}"), entry.alias(f"_p{k}"))
        rows = rows.withColumn(f"_c{k}", F.when(n >= k, F.slice(seq, n - k + 1, F.lit(k))))
        if k == 0 or small:  # without context there is one best event, and every row shares the key
            rows = rows.join(F.broadcast(tier), f"_c{k}", "left")
        else:
            rows = _looked_up(rows, tier, model.filter(F.col("length") == k), k)
        tiers.append(F.col(f"_p{k}"))
    rows = rows.withColumn("_p", F.coalesce(*tiers))
    return rows.withColumns(
        {
            "predicted_next_attack": F.col("_p.event"),
            "confidence": F.round("_p.probability", 4),
            "probability": F.col("_p.probability"),
            "context_length": F.col("_p.length"),
        }
    ).drop("_p", *[f"_{x}{k}" for x in "cp" for k in range(context + 1)])


def _last(events, k):
    """The last k entries of an array, in order."""
    return F.reverse(F.slice(F.reverse(events), F.lit(1), k))


def evaluate(recent: DataFrame, model: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Accuracy and log loss of predicting each row's event from the events before it; one row.

    Rows with the same history and outcome are counted together first, so the joins see distinct histories only.
    """
    seq, n = F.col("recent_events"), F.size("recent_events")
    cases = (
        recent.filter(n > 1)
        .select(
            F.element_at(seq, -1).alias("actual"),
            _last(F.slice(seq, F.lit(1), n - 1), F.lit(context)).alias("recent_events"),
        )
        .groupBy("actual", "recent_events")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    scored = predict(cases, model, context).withColumn("used", _last(seq, F.col("context_length")))
    truth = model.select(
        F.col("length").alias("context_length"),
        F.col("context").alias("used"),
        F.col("next_event").alias("actual"),
        F.col("probability").alias("p"),
    )
    scored = scored.join(truth, ["context_length", "used", "actual"], "left")
    rows = F.col("rows")
    loss = -F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(FLOOR)))
    right = F.when(F.col("actual") == F.col("predicted_next_attack"), rows).otherwise(0)
    return scored.agg(
        F.sum(rows).alias("samples"),
        F.round(F.sum(right) / F.sum(rows), 6).alias("accuracy"),
        F.round(F.sum(loss * rows) / F.sum(rows), 6).alias("log_loss"),
    )
