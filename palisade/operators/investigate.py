"""Investigation: recent events of an address, predicted next attack, narrative; sequence features and alerts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed
from palisade.functions import columns as C
from palisade.operators import predict as P
from palisade.operators.detect import KEY
from palisade.operators.ordered import by_heat, in_order
from palisade.session import inline_table
from palisade.sources.adapters import LOG_ORDER


def event_vector(event: Column, width: int = len(fixed.SEQUENCE_FEATURES)) -> Column:
    """Feature vector of an event name, those of 'unknown' for other names, aligned to `width`.

    Seven rows: a map literal answers the lookup without a join, so the expression also works on arrays of events.
    """
    rows = {e: [float(v) for v in values] for e, values in fixed.EVENT_VECTORS}
    entries = []
    for e, values in rows.items():
        entries += [F.lit(e), F.array(*[F.lit(v) for v in values])]
    table = F.create_map(*entries)
    found = F.coalesce(F.try_element_at(table, event), F.array(*[F.lit(v) for v in rows["unknown"]]))
    return C.align(found, width)


def event_vector_table(spark) -> DataFrame:
    rows = [(e, [float(v) for v in values]) for e, values in fixed.EVENT_VECTORS]
    return inline_table(spark, rows, "event string, vector array<double>")


def padded_sequence(recent: Column, length: int = fixed.SEQUENCE_LENGTH) -> Column:
    """Vectors of the last `length` events, zero vectors in front while there are fewer."""
    width = len(fixed.SEQUENCE_FEATURES)
    zero = F.array(*[F.lit(0.0)] * width)
    return F.concat(
        F.array_repeat(zero, F.lit(length) - F.size(recent)), F.transform(recent, lambda e: event_vector(e, width))
    )


def investigate(alerts: DataFrame, model: DataFrame | None = None, model_name: str = "N-gram model") -> DataFrame:
    """Add the investigation text; with a next-event model also predicted_next_attack and confidence.

    `alerts` has the address key and, for the model, recent_events.
    """
    if model is None:
        return alerts.withColumns(
            {
                "investigation": C.rule_investigation(F.col("event"), F.col("severity")),
                "investigation_method": F.lit("rule_based"),
            }
        )
    predicted = P.predict(alerts, model)
    text = C.prediction_text(
        F.col("predicted_next_attack"), F.col("probability"), F.size("recent_events"), F.col(KEY), model_name
    )
    rule = C.rule_investigation(F.col("event"), F.col("severity"))
    known = F.col("predicted_next_attack").isNotNull()
    return predicted.withColumns(
        {
            "investigation": F.when(known, text).otherwise(rule),
            "investigation_method": F.when(known, "sequence_model").otherwise("rule_based"),
        }
    ).drop("probability", "context_length")


def sequence_features(alerts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """The six live sequence features of rows with severity, failed_login_count and attack_frequency.

    `codes` (label, code) names the encoded events; events outside it are 0.
    """
    if codes is None:
        codes = inline_table(alerts.sparkSession, fixed.LABEL_CODES, "label string, code int")
    rows = alerts.join(F.broadcast(codes.withColumnRenamed("label", "event")), "event", "left")
    return rows.withColumns(
        {
            "attack_encoded": F.coalesce("code", F.lit(0)),
            "severity_encoded": C.severity_code(F.col("severity")),
            "anomaly_score": F.when(F.col("severity") == "HIGH", 0.9).otherwise(0.4),
            "packet_rate": F.coalesce("failed_login_count", F.lit(1)) * 100,
            "repeated_ip": (F.col("attack_frequency") > fixed.OFFENDER_ABOVE).cast("int"),
        }
    ).drop("code")


def live_vector() -> Column:
    """The six live features of a row of `sequence_features`, as one array."""
    return F.array(*[F.col(c).cast("double") for c in fixed.SEQUENCE_FEATURES])


def with_sequences(alerts: DataFrame, length: int = fixed.SEQUENCE_LENGTH, scope: str = "address") -> DataFrame:
    """recent_events, and `sequence`: the live features of the same events as they were when they happened.

    Scope `address` keeps a window per address; `global` runs one window over the order of all addresses together.
    `alerts` has failed_login_count and attack_frequency. For batches only.
    """

    def steps(rows, windows):
        rows = windows.trailing(rows, "recent_events", F.coalesce("event", F.lit("unknown")), length)
        return windows.trailing(rows, "sequence", F.col("_live"), length)

    rows = sequence_features(alerts).withColumn("_live", live_vector()).drop(*set(fixed.SEQUENCE_FEATURES) - {"attack_frequency"})
    rows = in_order(rows, LOG_ORDER, steps) if scope == "global" else by_heat(rows, KEY, LOG_ORDER, steps)
    return rows.drop("_live")


def latest_sequences(alerts: DataFrame) -> DataFrame:
    """The window of the last event of every address, of rows with `sequence`; combined map-side, one row per address."""
    last = F.max_by(F.struct("log_id", "sequence"), F.struct(*LOG_ORDER)).alias("last")
    return alerts.groupBy(F.col(KEY).alias("ip")).agg(last).select("ip", "last.log_id", "last.sequence")


def sequence_alerts(alerts: DataFrame, model: DataFrame, length: int = fixed.SEQUENCE_LENGTH) -> DataFrame:
    """Correlation records of rows whose window is full; `alerts` has recent_events and sequence."""
    full = alerts.filter(F.size("recent_events") == length)
    return P.predict(full, model).select(
        "log_id",
        F.col(KEY).alias("source_ip"),
        "sequence",
        "recent_events",
        "predicted_next_attack",
        "confidence",
        F.col("event").alias("current_event"),
        "severity",
        F.lit("sequence_correlation").alias("type"),
    )
