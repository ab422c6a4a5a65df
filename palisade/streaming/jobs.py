"""The streaming jobs: alerts, dead letters, summary, rates and sessions."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.functions import columns as C
from palisade.operators import analytics
from palisade.operators.detect import detect
from palisade.operators.intel import enrich
from palisade.operators.investigate import investigate
from palisade.operators.respond import action_log, reports, respond
from palisade.session import new_path
from palisade.sources import files
from palisade.streaming.stateful import stream_history


def good_logs(records: DataFrame) -> DataFrame:
    """Decoded log rows of a record stream that can be processed."""
    return files.split_dead_letters(files.decode_logs(records))[0]


def dated(rows: DataFrame) -> Column:
    """Rows whose own time can place them: those without a time, or with one a day ahead, must not move a watermark."""
    return F.coalesce(F.col("timestamp") < F.unix_timestamp() + 86_400, F.lit(False))


def with_event_time(rows: DataFrame, delay: str) -> DataFrame:
    """Dated rows with their event time `ts`, watermarked. Undated ones have no place in windows; they stay in the alerts."""
    placed = rows.filter(dated(rows))
    return placed.withColumn("ts", C.alert_time(F.col("timestamp"))).withWatermark("ts", delay)


def closing_record(seconds: float) -> str:
    """A record that moves the watermark past all windows that end before it, so that a finished stream gives them out."""
    return json.dumps({"log_id": 0, "event": "end_of_stream", "timestamp": seconds})


def stream_alerts(
    records: DataFrame, model: DataFrame | None = None, distinct: bool = True
) -> DataFrame:
    """Remediated alerts of a record stream: repeated log ids dropped, history per address, then stateless steps.

    The ids seen are kept in the state store without a limit in time: a late record is never taken for a repeated one.
    """
    logs = good_logs(records)
    if distinct:
        logs = logs.dropDuplicates(["log_id"])
    return respond(enrich(investigate(detect(stream_history(logs)), model)))


def store_alerts(alerts: DataFrame, table: str, checkpoint: str, outputs: str | None = None, **trigger) -> StreamingQuery:
    """Append alerts to the alert table, as detected and as remediated, and with `outputs` the action log and the reports.

    A micro-batch that is run again after a failure adds nothing twice: the table skips known ids and the other outputs
    are written to a folder of their batch number.
    """

    staging = new_path(alerts.sparkSession, "micro-batch")

    def write(batch: DataFrame, number: int) -> None:
        # evaluate the stateful part once per micro-batch: everything below reads the written rows
        path = f"{staging}/{number % 2}"
        batch.write.mode("overwrite").parquet(path)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(path)
        for stage in ("detected", "remediated"):
            files.append_alerts(rows, table, stage)
        if outputs:
            action_log(rows).write.mode("overwrite").json(f"{outputs}/actions/batch={number}")
            files.write_reports(reports(rows), f"{outputs}/reports/batch={number}")

    writer = alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(**trigger) if trigger else writer).start()


def store_dead_letters(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    dead = files.split_dead_letters(files.decode_logs(records))[1]
    writer = dead.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def store_summary(alerts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Running incident counts by severity, tactic and address; every trigger replaces the snapshot."""
    counts = analytics.dimension_counts(alerts)

    def write(batch: DataFrame, _: int) -> None:
        files.write_summary(analytics.zero_filled(batch), path)

    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_alert_rate(alerts: DataFrame, every: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    return analytics.alert_rate(with_event_time(alerts, delay), every, slide)


def stream_sessions(logs: DataFrame, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per address; a session is emitted when the watermark has passed its end."""
    rows = with_event_time(logs, delay)
    return (
        rows.groupBy(F.session_window("ts", gap).alias("w"), C.or_unknown(F.col("ip")).alias("ip"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("ip", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    )
