"""Dashboard queries over the alert table: counts, charts, pages and feeds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import fixed
from palisade.functions import columns as C
from palisade.session import inline_table

PAGE_DEFAULT, PAGE_MAX, FEED_ROWS, PREDICTION_ROWS = 100, 500, 20, 5


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Total, critical and malware counts in one pass."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("event").ilike("%malware%")).alias("malware_count"),
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    """One row with a map severity -> count, the four levels always present."""
    levels = inline_table(
        alerts.sparkSession, [(s, 0) for s in fixed.SEVERITY_CODES], "severity string, n bigint"
    )
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("severity").isNotNull())
    summed = counts.unionByName(levels).groupBy("severity").agg(F.sum("n").alias("n"))
    return summed.agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("severity_counts"))


def severity_chart(alerts: DataFrame) -> DataFrame:
    """Count per severity in rising order, zero where a level has no alert."""
    levels = inline_table(alerts.sparkSession, list(fixed.SEVERITY_CODES.items()), "severity string, level int")
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return (
        levels.join(counts, "severity", "left")
        .select("severity", "level", F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("level")
    )


def dimension_counts(alerts: DataFrame) -> DataFrame:
    """Incident counts in total, by severity, by tactic and by address, in one pass. Batch or stream."""
    values = {
        "total": F.lit("all"),
        "severity": F.coalesce("severity", F.lit("LOW")),
        "tactic": F.coalesce("mitre_tactic", F.lit("Unknown")),
        "ip": C.or_unknown(F.col("ip")),
    }
    pairs = [F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in values.items()]
    rows = alerts.select(F.explode(F.array(*pairs)).alias("d"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("incidents"))


def zero_filled(counts: DataFrame) -> DataFrame:
    """The counts with the total and the four severity levels always present."""
    zero = inline_table(
        counts.sparkSession,
        [("total", "all", 0)] + [("severity", s, 0) for s in fixed.SEVERITY_CODES],
        "dimension string, value string, incidents bigint",
    )
    return counts.unionByName(zero).groupBy("dimension", "value").agg(F.sum("incidents").alias("incidents"))


def incident_summary(alerts: DataFrame) -> DataFrame:
    return zero_filled(dimension_counts(alerts))


def top_addresses(alerts: DataFrame, k: int = 10) -> DataFrame:
    counts = alerts.groupBy(C.or_unknown(F.col("ip")).alias("ip")).agg(F.count(F.lit(1)).alias("incidents"))
    return counts.orderBy(F.desc("incidents"), "ip").limit(k)


def page(alerts: DataFrame, limit: int = PAGE_DEFAULT, skip: int = 0, before: int | None = None) -> DataFrame:
    """Newest alerts first. `before` (the last id of the previous page) avoids sorting through the skipped rows."""
    rows = alerts if before is None else alerts.filter(F.col("log_id") < before)
    rows = rows.orderBy(F.desc("log_id"))
    rows = rows.offset(skip) if skip else rows
    return rows.limit(min(limit, PAGE_MAX)).select(
        F.col("log_id").alias("id"),
        "event",
        "severity",
        "ip",
        "user",
        "investigation",
        "mitre_attack",
        "predicted_next_attack",
        "confidence",
        C.iso_utc(F.col("timestamp").cast("double")).alias("timestamp"),
    )


def _confidence() -> Column:
    """The confidence as a number; the alert table keeps it as text."""
    return F.col("confidence").cast("double")


def live_feed(alerts: DataFrame, rows: int = FEED_ROWS) -> DataFrame:
    """The newest alerts as they are shown."""
    newest = alerts.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(rows)
    return newest.select(
        "log_id",
        F.coalesce(C.shown_event(F.col("event")), F.lit("SYSTEM")).alias("title"),
        F.coalesce("severity", F.lit("LOW")).alias("severity"),
        C.shown(F.col("ip")).alias("ip"),
        C.shown(F.col("user")).alias("user"),
        "mitre_attack",
        F.when(
            F.col("predicted_next_attack") != "",
            F.concat(
                F.col("predicted_next_attack"),
                F.when(_confidence() != 0, F.concat(F.lit(" ("), C.percent(_confidence()), F.lit(")"))).otherwise(""),
            ),
        ).alias("next_predicted"),
    )


def recent_predictions(alerts: DataFrame, newest: int = FEED_ROWS, rows: int = PREDICTION_ROWS) -> DataFrame:
    """The first predictions other than BENIGN among the newest alerts; the newest are cut before the filter."""
    order = F.desc("log_id")
    attack = F.col("predicted_next_attack")
    return (
        alerts.orderBy(order)
        .limit(newest)
        .filter(attack.isNotNull() & (attack != "") & (attack != "BENIGN"))
        .orderBy(order)
        .limit(rows)
        .select(
            "log_id",
            "predicted_next_attack",
            F.replace("event", F.lit("_"), F.lit(" ")).alias("triggered_by"),
            F.coalesce(F.nullif("ip", F.lit("")), F.lit("unknown IP")).alias("ip"),
            F.when(_confidence() != 0, C.percent(_confidence())).alias("confidence"),
        )
    )


def alert_rate(alerts: DataFrame, every: str, slide: str | None = None) -> DataFrame:
    """Alerts per severity and time window; `alerts.ts` is a timestamp. Works on batches and on watermarked streams."""
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    return (
        alerts.groupBy(window.alias("w"), "severity")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "alerts")
    )


def address_sessions(logs: DataFrame, gap: int = fixed.FREQUENCY_TTL_SECONDS) -> DataFrame:
    """Activity sessions per address: first and last epoch second, number of events; closed by silence above `gap`.

    Events of an address inside one span of `gap` seconds always share a session, so they are combined map-side first;
    the window per address then sees at most one row per span of time, however busy the address is.
    """
    spans = (
        logs.groupBy(C.or_unknown(F.col("ip")).alias("ip"), F.floor(F.col("timestamp") / gap).alias("span"))
        .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("ip").orderBy("span")
    silence = F.col("first") - F.lag("last").over(order)
    fresh = F.when(silence.isNull() | (silence > gap), 1).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spans.withColumn("_fresh", fresh)
        .withColumn("session", F.sum("_fresh").over(upto))
        .groupBy("ip", "session")
        .agg(F.min("first").alias("session_start"), F.max("last").alias("session_last"), F.sum("n").alias("events"))
    )
