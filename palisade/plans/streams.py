"""Queries that replay the log events through the streaming jobs; their results equal those of the batch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.plans.logs import _MICROS, _SEQUENCES, _SUMMARY
from palisade.plans.registry import query
from palisade.plans.stores import TWO_STAGES
from palisade.plans.sql import logs
from palisade.session import made_once, new_path
from palisade.sources import files
from palisade.sources.adapters import soc_logs
from palisade.sources.streams import folder_sink, folder_source
from palisade.streaming import batches, jobs
from palisade.streaming.ledger import Ledger
from palisade.streaming.stateful import prepare_session, stream_history

# The events cover 30 days; each part of the replay is one run of the stream that resumes from its checkpoint.
_FIRST_DAY, _PARTS, _DAY = 1704067200, 3, 86400


def replay(spark, sf_dir: str, start, parts: int = _PARTS, closing: bool = False) -> None:
    """Write the logs as JSON records in time order, part by part, and run the stream after each part.

    `start(records, session)` starts the query on the record stream; each run picks up where the last one stopped. With
    `closing`, a last run reads a record ten days later, so that no window or session stays open.
    """
    session = spark.newSession()
    prepare_session(session)
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    folder = new_path(spark, "records")
    logs_ = soc_logs(spark, sf_dir).drop("k")
    part = F.floor((F.col("timestamp") - _FIRST_DAY) / (30 * _DAY / parts))
    for i in range(parts):
        chosen = logs_.filter(F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)) == i)
        files.encode_json(chosen).write.mode("append").text(folder)
        start(folder_source(session, folder), session).awaitTermination()
    if closing:
        end = spark.range(1).select(F.lit(jobs.closing_record(_FIRST_DAY + 40 * _DAY)).alias("value"))
        end.write.mode("append").text(folder)
        start(folder_source(session, folder), session).awaitTermination()


@query(
    "stream_history",
    logs("""SELECT log_id, addr AS ip, flc AS failed_login_count, attack_frequency, concat_ws('>', e5, e4, e3, e2, e1) AS recent FROM det"""),
)
def stream_history_(spark, sf_dir) -> DataFrame:
    out, state = new_path(spark, "history"), new_path(spark, "state")

    def start(records, _):
        rows = stream_history(jobs.good_logs(records)).select(
            "log_id",
            F.col("_address").alias("ip"),
            "failed_login_count",
            "attack_frequency",
            F.array_join("recent_events", ">").alias("recent"),
        )
        return folder_sink(rows, out, state, "parquet", availableNow=True)

    replay(spark, sf_dir, start)
    return spark.read.parquet(out)


@query(
    "stream_alert_store",
    logs(TWO_STAGES),
)
def stream_alert_store(spark, sf_dir) -> DataFrame:
    """Records to alerts in the alert table, as detected and as remediated."""
    table, state = new_path(spark, "alerts"), new_path(spark, "state")
    replay(spark, sf_dir, lambda records, _: jobs.store_alerts(jobs.stream_alerts(records), table, state, availableNow=True))
    stored = files.read_alerts(spark, table)
    return stored.select("log_id", "stage", "event", "severity", "ip", "user", "investigation", "mitre_attack")


@query("stream_summary", logs(_SUMMARY))
def stream_summary(spark, sf_dir) -> DataFrame:
    """Alerts of a stream, then the running summary over the alert stream."""
    alerts, summary = new_path(spark, "alert-records"), new_path(spark, "summary")
    states = new_path(spark, "state"), new_path(spark, "state")

    def start(records, session):
        made = jobs.stream_alerts(records, distinct=False).select("log_id", "severity", "mitre_tactic", "ip")
        folder_sink(made, alerts, states[0], "parquet", availableNow=True).awaitTermination()
        read = session.readStream.schema(made.schema).parquet(alerts)
        return jobs.store_summary(read, summary, states[1], availableNow=True)

    replay(spark, sf_dir, start)
    return spark.read.parquet(summary).drop("last_updated")


@query(
    "stream_alert_rate",
    logs(f"""SELECT window_start, severity, count(*) AS alerts FROM (
             SELECT ({_MICROS}//600000000)*600 AS window_start, CASE
              WHEN event IN ('malware_detected','privilege_escalation','unauthorized_access') THEN 'HIGH'
              WHEN event IN ('port_scan','ddos_attempt') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM soc_logs) t
             GROUP BY window_start, severity"""),
)
def stream_alert_rate(spark, sf_dir) -> DataFrame:
    """Windowed alert counts in append mode: all windows, the last ones closed by the closing record."""
    from palisade.functions import columns as C

    out, state = new_path(spark, "rates"), new_path(spark, "state")

    def start(records, _):
        alerts = jobs.good_logs(records).withColumn("severity", C.rule_severity(F.col("event")))
        rates = jobs.stream_alert_rate(alerts, "10 minutes")
        return folder_sink(rates, out, state, "parquet", availableNow=True)

    replay(spark, sf_dir, start, closing=True)
    return spark.read.parquet(out).select(F.unix_timestamp("window_start").alias("window_start"), "severity", "alerts")


@query(
    "stream_sessions",
    logs(f"""SELECT ip, session_start, session_end, events FROM (
             SELECT addr AS ip, min({_MICROS}) AS session_start, max({_MICROS})+3600000000 AS session_end, count(*) AS events
             FROM islands GROUP BY addr, island) t"""),
)
def stream_sessions(spark, sf_dir) -> DataFrame:
    """Sessions per address in append mode: all of them, the last ones closed by the closing record."""
    out, state = new_path(spark, "sessions"), new_path(spark, "state")

    def start(records, _):
        return folder_sink(jobs.stream_sessions(jobs.good_logs(records)), out, state, "parquet", availableNow=True)

    replay(spark, sf_dir, start, closing=True)
    return spark.read.parquet(out).select(
        "ip", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "events"
    )


# --- through the ledger

_PART = f"least(greatest(floor((\"timestamp\"-{_FIRST_DAY})/{30 * _DAY / _PARTS}),0),{_PARTS - 1})"


def ledger_of(spark, sf_dir: str, kind: str) -> str:
    """The ledger of a replay, made once per application and kind: `repeats`, `late` or `unnamed`.

    Every part is one run of the stream. `repeats` sends a tenth of each part again with the next one; `late` keeps a
    fiftieth back until the next part; `unnamed` sends records without id, their times cut to the hour, some cut off.
    """
    return made_once(spark, (sf_dir, f"ledger-{kind}"), lambda root: _replay_into(spark, sf_dir, kind, root))


def _replay_into(spark, sf_dir: str, kind: str, root: str) -> None:
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    folder, state = new_path(spark, "records"), new_path(spark, "state")
    logs_ = soc_logs(spark, sf_dir)
    part = F.floor((F.col("timestamp") - _FIRST_DAY) / (30 * _DAY / _PARTS))
    logs_ = logs_.withColumn("_part", F.least(F.greatest(part, F.lit(0)), F.lit(_PARTS - 1)))
    if kind == "repeats":
        again = logs_.where("log_id % 10 = 3").withColumn("_part", F.col("_part") + 1)
        logs_ = logs_.unionByName(again)
    elif kind == "late":
        logs_ = logs_.withColumn("_part", F.col("_part") + F.when(F.col("log_id") % 50 == 7, 1).otherwise(0))
    for i in range(_PARTS + 1):
        own = logs_.where(F.col("_part") == i)
        if kind == "unnamed":
            hour = F.floor(F.col("timestamp") / 3600) * 3600
            text = F.to_json(F.struct("event", "ip", hour.cast("double").alias("timestamp")))
            records = own.select(F.when(F.col("k") % 20 == 5, F.substring(text, 1, 9)).otherwise(text).alias("value"))
        else:
            records = files.encode_json(own.drop("k", "_part"))
        records.write.mode("append").text(folder)
        batches.run(folder_source(session, folder), root, state, availableNow=True).awaitTermination()


@query("ledger_alerts", logs(TWO_STAGES))
def ledger_alerts(spark, sf_dir) -> DataFrame:
    """Alerts of a replay with repeated records and four runs: each is stored once per stage."""
    stored = batches.alerts(spark, ledger_of(spark, sf_dir, "repeats"))
    return stored.select("log_id", "stage", "event", "severity", "ip", "user", "investigation", "mitre_attack")


def _chain(spark, sf_dir: str) -> DataFrame:
    root = ledger_of(spark, sf_dir, "repeats")
    written = spark.read.parquet(f"{root}/chain")
    return written.where(F.col("version") <= Ledger(spark, root).last()[0])


@query(
    "ledger_history",
    logs("""SELECT log_id, addr AS ip, flc AS failed_login_count, attack_frequency, concat_ws('>', e5, e4, e3, e2, e1) AS recent FROM det"""),
)
def ledger_history(spark, sf_dir) -> DataFrame:
    """History columns carried from batch to batch in the ledger's table of addresses."""
    return _chain(spark, sf_dir).select(
        "log_id", F.col("_address").alias("ip"), "failed_login_count", "attack_frequency", F.array_join("recent_events", ">").alias("recent")
    )


@query("ledger_summary", logs(_SUMMARY))
def ledger_summary(spark, sf_dir) -> DataFrame:
    return batches.summary(spark, ledger_of(spark, sf_dir, "repeats"))


@query(
    "ledger_sequences",
    logs("""SELECT d.log_id, addr AS source_ip, concat_ws('>', e5, e4, e3, e2, e1) AS events, s.sequence,
            ev AS current_event, severity, 'sequence_correlation' AS type
            FROM det d JOIN own_seq s ON s.log_id=d.log_id WHERE rn>=5""", _SEQUENCES),
)
def ledger_sequences(spark, sf_dir) -> DataFrame:
    """Sequence alerts read back from their topic: the live features of the last five events of an address."""
    from palisade.plans.logs import _sequence_text

    records = batches.topic(spark, ledger_of(spark, sf_dir, "repeats"), "sequence_alerts")
    rows = records.select(F.from_json("value", batches.SEQUENCE).alias("r")).select("r.*")
    return rows.select(
        "log_id", "source_ip", F.array_join("recent_events", ">").alias("events"), _sequence_text().alias("sequence"),
        "current_event", "severity", "type",
    )


@query(
    "ledger_topics",
    logs("""SELECT t.topic, severity, count(*) AS records, CAST(sum(log_id) AS BIGINT) AS ids,
            count(*) FILTER (WHERE t.topic IN ('threat_enriched_alerts','remediation_actions') AND mitre_attack IS NOT NULL) AS enriched
            FROM (SELECT log_id, severity, rn, mitre_attack FROM rule_enr) e
            JOIN (VALUES ('soc_alerts'),('investigated_alerts'),('threat_enriched_alerts'),('remediation_actions'),('sequence_alerts')) t(topic)
             ON t.topic<>'sequence_alerts' OR rn>=5
            GROUP BY ALL"""),
)
def ledger_topics(spark, sf_dir) -> DataFrame:
    """The records of the five stages, published from one evaluation, by severity."""
    root, found = ledger_of(spark, sf_dir, "repeats"), None
    for name in [*batches.TOPICS, "sequence_alerts"]:
        record = F.from_json("value", "log_id long, severity string, mitre_attack string").alias("r")
        rows = batches.topic(spark, root, name).select(F.lit(name).alias("topic"), record)
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("topic", F.col("r.severity").alias("severity")).agg(
        F.count("*").alias("records"), F.sum("r.log_id").alias("ids"), F.count("r.mitre_attack").alias("enriched")
    )


# a batch's limit is ten minutes before the newest event of all batches before it
_LATE = f"""parts AS (SELECT *, {_PART} AS own, {_PART} + CASE WHEN log_id%50=7 THEN 1 ELSE 0 END AS sent FROM det),
newest AS (SELECT b.p, max("timestamp") AS t FROM range(1, {_PARTS + 1}) b(p) JOIN parts ON sent<b.p GROUP BY b.p),
placed AS (SELECT parts.*, coalesce("timestamp" < t-600, false) AS late FROM parts LEFT JOIN newest ON p=sent)"""


@query(
    "ledger_late",
    logs(f"""SELECT 'in time' AS cause, ({_MICROS}//600000000)*600 AS window_start, count(*) AS alerts
             FROM placed WHERE NOT late GROUP BY ALL
             UNION ALL SELECT 'late', NULL, count(*) FROM placed WHERE late""", _LATE),
)
def ledger_late(spark, sf_dir) -> DataFrame:
    """Windowed alert counts and the alerts that came too late for them: together all that was sent."""
    root = ledger_of(spark, sf_dir, "late")
    late = batches.set_aside(spark, root).groupBy("cause").agg(F.count("*").alias("alerts"))
    rates = batches.rates(spark, root).groupBy("window_start").agg(F.sum("alerts").alias("alerts"))
    return rates.withColumn("cause", F.lit("in time")).unionByName(late, allowMissingColumns=True)


@query(
    "ledger_unnamed",
    logs("""SELECT addr AS ip, count(*) AS stored, greatest(count(*) FILTER (WHERE ev='failed_login' AND ip IS NOT NULL)-5, 0) AS escalated
            FROM det WHERE k%20<>5 GROUP BY addr UNION ALL SELECT 'malformed', count(*), 0 FROM det WHERE k%20=5"""),
)
def ledger_unnamed(spark, sf_dir) -> DataFrame:
    """Records without id, many of them equal: all are stored or set aside, and every failed login counts."""
    root = ledger_of(spark, sf_dir, "unnamed")
    stored = batches.alerts(spark, root).where("stage = 'remediated'")
    high = F.count_if((F.col("event") == "failed_login") & (F.col("severity") == "HIGH"))
    by_ip = stored.groupBy(F.coalesce("ip", F.lit("unknown")).alias("ip")).agg(F.count_distinct("log_id").alias("stored"), high.alias("escalated"))
    dead = batches.set_aside(spark, root).where("cause = 'malformed'").groupBy(F.col("cause").alias("ip")).agg(
        F.count("*").alias("stored"), F.lit(0).cast("long").alias("escalated")
    )
    return by_ip.unionByName(dead)
