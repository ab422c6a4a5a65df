"""Threat enrichment: map an alert to a technique by event name, predicted attack or keyword."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed
from palisade.session import inline_table

_ENTRY = ["technique", "tactic", "confidence", "action"]


def techniques(spark) -> DataFrame:
    """The fixed technique table (20 rows)."""
    schema = "name string, technique string, tactic string, confidence double, action string"
    return inline_table(spark, fixed.TECHNIQUES, schema)


def _entry(technique, tactic, confidence, action, method, kind) -> Column:
    return F.struct(
        technique.alias("technique"),
        tactic.alias("tactic"),
        confidence.alias("confidence"),
        action.alias("action"),
        method.alias("method"),
        F.lit(kind).alias("kind"),
    )


def keyword_entry(event: Column) -> Column:
    """Technique of the first keyword inside the event name; null when there is none."""
    name = F.lower(event)
    tiers = []
    for keyword, technique, tactic, confidence, action in fixed.KEYWORD_TECHNIQUES:
        entry = _entry(
            *[F.lit(v) for v in (technique, tactic, confidence, action, fixed.KEYWORD_NOTE % keyword)], "fuzzy"
        )
        tiers.append(F.when(F.contains(name, F.lit(keyword)), entry))
    return F.coalesce(*tiers)


def enrich(alerts: DataFrame) -> DataFrame:
    """Add technique, tactic, confidence, action, how they were found and `match_kind`.

    Order: event name, predicted attack (confidence discounted), keyword in the event name, unclassified.
    """
    known = techniques(alerts.sparkSession)
    entry = F.struct(*_ENTRY)
    if "predicted_next_attack" not in alerts.columns:
        alerts = alerts.withColumn("predicted_next_attack", F.lit(None).cast("string"))
    by_event = known.select(F.col("name").alias("event"), entry.alias("_by_event"))
    by_prediction = known.select(F.col("name").alias("predicted_next_attack"), entry.alias("_by_prediction"))
    joined = alerts.join(F.broadcast(by_event), "event", "left").join(
        F.broadcast(by_prediction), "predicted_next_attack", "left"
    )
    e, p = F.col("_by_event"), F.col("_by_prediction")
    intel = F.coalesce(
        F.when(
            e.isNotNull(), _entry(e.technique, e.tactic, e.confidence, e.action, F.lit(fixed.EXACT_NOTE), "exact")
        ),
        F.when(
            p.isNotNull(),
            _entry(
                p.technique,
                p.tactic,
                F.round(p.confidence * fixed.PREDICTED_DISCOUNT, 2),
                p.action,
                F.format_string(fixed.PREDICTED_NOTE, F.col("predicted_next_attack")),
                "predicted",
            ),
        ),
        keyword_entry(F.col("event")),
        _entry(*[F.lit(v) for v in (*fixed.UNKNOWN_TECHNIQUE, fixed.EXACT_NOTE)], "unknown"),
    )
    return (
        joined.withColumn("_intel", intel)
        .withColumns(
            {
                "mitre_attack": F.col("_intel.technique"),
                "mitre_tactic": F.col("_intel.tactic"),
                "mitre_confidence": F.col("_intel.confidence"),
                "recommended_action": F.col("_intel.action"),
                "threat_intel_method": F.col("_intel.method"),
                "match_kind": F.col("_intel.kind"),
            }
        )
        .drop("_intel", "_by_event", "_by_prediction")
    )
