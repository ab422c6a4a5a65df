"""Queries over the log events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed
from palisade.functions import columns as C
from palisade.operators import analytics, pipeline
from palisade.operators import predict as P
from palisade.operators.detect import KEY, detect, flow_vectors, with_history
from palisade.operators.intel import enrich, keyword_entry
from palisade.operators.investigate import (
    event_vector,
    event_vector_table,
    investigate,
    latest_sequences,
    padded_sequence,
    sequence_alerts,
    sequence_features,
    with_sequences,
)
from palisade.operators.respond import action_log, exploded_actions, reports
from palisade.plans.registry import query
from palisade.plans.sql import RULE_TEXT, context_of, logs, pct
from palisade.session import made_once
from palisade.sources import files
from palisade.sources.adapters import soc_logs


def rounded_text(vector, factor: int):
    """Numbers of an array as whole multiples of 1/factor, comma separated."""
    whole = F.transform(vector, lambda x: F.floor(x * factor + 0.5).cast("bigint").cast("string"))
    return F.array_join(whole, ",")


# --- detection --------------------------------------------------------------------------------------------------------


@query(
    "json_decode",
    """SELECT event_id AS log_id, CAST(json_extract_string(props,'$.k') AS INT) AS k,
       CASE WHEN json_extract_string(props,'$.missing') IS NULL THEN 'absent' ELSE 'present' END AS optional_key
       FROM events""",
)
def json_decode(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    parsed = F.from_json("props", "k int, missing string", {"mode": "PERMISSIVE"})
    rows = rows.select(F.col("event_id").alias("log_id"), parsed.alias("p"))
    optional = F.when(F.col("p.missing").isNull(), "absent").otherwise("present")
    return rows.select("log_id", "p.k", optional.alias("optional_key"))


@query("rule_severity", logs("SELECT log_id, CASE WHEN flc>5 AND ev='failed_login' THEN 'LOW' ELSE severity END AS severity FROM det"))
def rule_severity(spark, sf_dir) -> DataFrame:
    return soc_logs(spark, sf_dir).select("log_id", C.rule_severity(F.col("event")).alias("severity"))


@query("failed_login_running", logs("SELECT log_id, ip, flc AS failed_login_count FROM hist WHERE flc IS NOT NULL"))
def failed_login_running(spark, sf_dir) -> DataFrame:
    rows = with_history(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip"))
    return rows.filter(F.col("failed_login_count").isNotNull()).select("log_id", "ip", "failed_login_count")


@query("bruteforce_escalation", logs("SELECT log_id, addr AS ip, flc AS failed_login_count, severity FROM det WHERE flc>5"))
def bruteforce_escalation(spark, sf_dir) -> DataFrame:
    rows = detect(with_history(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")))
    return rows.filter(F.col("failed_login_count") > 5).select("log_id", "ip", "failed_login_count", "severity")


@query(
    "detect_alerts",
    logs("""SELECT log_id, ev AS event, severity, ip, "user", 'rule_based' AS detection_method, flc AS failed_login_count,
            "timestamp" FROM det"""),
)
def detect_alerts(spark, sf_dir) -> DataFrame:
    names = ["log_id", "event", "severity", "ip", "user", "detection_method", "failed_login_count", "timestamp"]
    return detect(with_history(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip", "user"))).select(*names)


@query(
    "flow_features",
    logs("""SELECT log_id, coalesce(flow_duration, d.f1, u.f1) AS f1, coalesce(d.f2,u.f2) AS f2,
            coalesce(d.f3,u.f3) AS f3, coalesce(d.f4,u.f4) AS f4, coalesce(d.f5,u.f5) AS f5, coalesce(d.f6,u.f6) AS f6,
            coalesce(d.f7,u.f7) AS f7, coalesce(d.f8,u.f8) AS f8, coalesce(d.f9,u.f9) AS f9, coalesce(d.f10,u.f10) AS f10
            FROM soc_logs l LEFT JOIN flow_defaults d ON d.event=l.event
            LEFT JOIN flow_defaults u ON u.event='unknown'"""),
)
def flow_features(spark, sf_dir) -> DataFrame:
    rows = flow_vectors(soc_logs(spark, sf_dir))
    return rows.select("log_id", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(10)])


# --- investigation ----------------------------------------------------------------------------------------------------


@query("rule_investigation", logs(f"SELECT log_id, {RULE_TEXT} AS investigation, 'rule_based' AS investigation_method FROM det"))
def rule_investigation(spark, sf_dir) -> DataFrame:
    alerts = detect(with_history(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")))
    return investigate(alerts).select("log_id", "investigation", "investigation_method")


@query(
    "event_vectors",
    logs("""SELECT log_id, coalesce(v.v1,u.v1) AS v1, coalesce(v.v2,u.v2) AS v2, coalesce(v.v3,u.v3) AS v3,
            coalesce(v.v4,u.v4) AS v4, coalesce(v.v5,u.v5) AS v5, coalesce(v.v6,u.v6) AS v6
            FROM soc_logs l LEFT JOIN vectors v ON v.event=l.event LEFT JOIN vectors u ON u.event='unknown'"""),
)
def event_vectors(spark, sf_dir) -> DataFrame:
    known = event_vector_table(spark)
    unknown = [float(v) for v in dict(fixed.EVENT_VECTORS)["unknown"]]
    rows = soc_logs(spark, sf_dir).select("log_id", "event").join(F.broadcast(known), "event", "left")
    vector = F.coalesce("vector", F.array(*[F.lit(v) for v in unknown]))
    return rows.select("log_id", *[vector[i].alias(f"v{i + 1}") for i in range(6)])


@query(
    "align_vector",
    logs("""SELECT log_id, concat_ws(',', v1, v2, v3, v4) AS cut, concat_ws(',', v1, v2, v3, v4, v5, v6, 0, 0) AS padded FROM (
            SELECT log_id, CAST(coalesce(v.v1,u.v1) AS BIGINT) AS v1, CAST(coalesce(v.v2,u.v2) AS BIGINT) AS v2,
             CAST(floor(coalesce(v.v3,u.v3)+0.5) AS BIGINT) AS v3, CAST(coalesce(v.v4,u.v4) AS BIGINT) AS v4,
             CAST(coalesce(v.v5,u.v5) AS BIGINT) AS v5, CAST(coalesce(v.v6,u.v6) AS BIGINT) AS v6
            FROM soc_logs l LEFT JOIN vectors v ON v.event=l.event LEFT JOIN vectors u ON u.event='unknown') t"""),
)
def align_vector(spark, sf_dir) -> DataFrame:
    vector = event_vector(F.col("event"))
    rows = soc_logs(spark, sf_dir)
    return rows.select(
        "log_id",
        rounded_text(C.align(vector, 4), 1).alias("cut"),
        rounded_text(C.align(vector, 8), 1).alias("padded"),
    )


def _vector_text(event: str) -> str:
    """A vector as whole hundredths, or zeros in front of the first event."""
    parts = ", ".join(f"CAST(floor(coalesce(v.v{i},u.v{i})*100+0.5) AS BIGINT)" for i in range(1, 7))
    return (
        f"CASE WHEN {event} IS NULL THEN '0,0,0,0,0,0' ELSE (SELECT concat_ws(',', {parts}) FROM "
        f"(SELECT * FROM vectors WHERE event='unknown') u LEFT JOIN vectors v ON v.event={event}) END"
    )


@query(
    "ip_sequence_window",
    logs(f"""SELECT log_id, addr AS ip, n_recent, concat_ws(';', {", ".join(f"t{i}.txt" for i in (5, 4, 3, 2, 1))}) AS sequence
            FROM det d {" ".join(f"LEFT JOIN (SELECT e, {_vector_text('e')} AS txt FROM (SELECT DISTINCT ev AS e FROM det UNION ALL SELECT NULL) x) t{i} ON t{i}.e IS NOT DISTINCT FROM d.e{i}" for i in range(1, 6))}"""),
)
def ip_sequence_window(spark, sf_dir) -> DataFrame:
    rows = with_history(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip"), failed=False, recent=5)
    vectors = F.transform(padded_sequence(F.col("recent_events")), lambda v: rounded_text(v, 100))
    return rows.select(
        "log_id", F.col(KEY).alias("ip"), F.size("recent_events").alias("n_recent"), F.array_join(vectors, ";").alias("sequence")
    )


@query(
    "attack_context",
    logs(f"""SELECT log_id, attack, {context_of("attack")} AS context FROM (
            SELECT log_id, CASE k%5 WHEN 0 THEN 'DoS Hulk' WHEN 1 THEN ev WHEN 2 THEN 'Slow DDoS variant'
             WHEN 3 THEN concat('portscan ', ev) ELSE 'Heartbleed' END AS attack FROM det) t"""),
)
def attack_context(spark, sf_dir) -> DataFrame:
    event, kind = F.coalesce("event", F.lit("unknown")), F.col("k") % 5
    attack = (
        F.when(kind == 0, "DoS Hulk")
        .when(kind == 1, event)
        .when(kind == 2, "Slow DDoS variant")
        .when(kind == 3, F.concat(F.lit("portscan "), event))
        .otherwise("Heartbleed")
    )
    rows = soc_logs(spark, sf_dir).select("log_id", attack.alias("attack"))
    return rows.select("log_id", "attack", C.attack_context(F.col("attack")).alias("context"))


@query(
    "investigation_text",
    logs("SELECT log_id, predicted_next_attack, confidence, investigation, 'sequence_model' AS investigation_method FROM inv"),
)
def investigation_text(spark, sf_dir) -> DataFrame:
    alerts = detect(with_history(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip"), recent=5))
    rows = investigate(alerts, P.fit(alerts))
    return rows.select("log_id", "predicted_next_attack", "confidence", "investigation", "investigation_method")


@query("attack_frequency", logs("SELECT log_id, addr AS ip, attack_frequency FROM freq"))
def attack_frequency(spark, sf_dir) -> DataFrame:
    rows = soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")
    rows = with_history(rows, failed=False, frequency=True)
    return rows.select("log_id", F.col(KEY).alias("ip"), "attack_frequency")


@query("history_sliced", logs("SELECT log_id, flc AS failed_login_count, attack_frequency, concat_ws('>', e5, e4, e3, e2, e1) AS recent FROM det"))
def history_sliced(spark, sf_dir) -> DataFrame:
    """All history columns with every address treated as hot, i.e. over slices of the total order."""
    rows = soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")
    rows = with_history(rows, frequency=True, recent=5, limit=0)
    recent = F.array_join("recent_events", ">").alias("recent")
    return rows.select("log_id", "failed_login_count", "attack_frequency", recent)


@query(
    "sequence_features",
    logs("""SELECT log_id, coalesce(c.code,0) AS attack_encoded,
            CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS severity_encoded,
            CASE WHEN severity='HIGH' THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS anomaly_score,
            coalesce(flc,1)*100 AS packet_rate, attack_frequency,
            CASE WHEN attack_frequency>3 THEN 1 ELSE 0 END AS repeated_ip
            FROM det LEFT JOIN codes c ON c.name=ev"""),
)
def sequence_features_(spark, sf_dir) -> DataFrame:
    rows = soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")
    alerts = detect(with_history(rows, frequency=True)).drop("anomaly_score")
    return sequence_features(alerts).select("log_id", *fixed.SEQUENCE_FEATURES)


# The live features of every event in whole hundredths, and the windows over them.
_SEQUENCES = """
live AS (SELECT d.*, concat_ws(',', coalesce(c.code,0)*100, CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 100 ELSE 200 END,
  CASE WHEN severity='HIGH' THEN 90 ELSE 40 END, coalesce(flc,1)*10000, attack_frequency*100,
  CASE WHEN attack_frequency>3 THEN 100 ELSE 0 END) AS v FROM det d LEFT JOIN codes c ON c.name=ev),
own_seq AS (SELECT log_id, concat_ws(';', lag(v,4) OVER w, lag(v,3) OVER w, lag(v,2) OVER w, lag(v,1) OVER w, v) AS sequence
  FROM live WINDOW w AS (PARTITION BY addr ORDER BY "timestamp", log_id)),
all_seq AS (SELECT log_id, addr, concat_ws(';', lag(v,4) OVER w, lag(v,3) OVER w, lag(v,2) OVER w, lag(v,1) OVER w, v) AS sequence,
   row_number() OVER (PARTITION BY addr ORDER BY "timestamp" DESC, log_id DESC) AS newest
  FROM live WINDOW w AS (ORDER BY "timestamp", log_id))
"""


def _sequence_text():
    return F.array_join(F.transform("sequence", lambda v: rounded_text(v, 100)), ";").alias("sequence")


def _live_alerts(spark, sf_dir) -> DataFrame:
    rows = soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")
    return detect(with_history(rows, frequency=True))


@query(
    "sequence_alerts",
    logs("""SELECT i.log_id, addr AS source_ip, concat_ws('>', e5, e4, e3, e2, e1) AS events, s.sequence, predicted_next_attack,
            confidence, ev AS current_event, severity, 'sequence_correlation' AS type
            FROM inv i JOIN own_seq s ON s.log_id=i.log_id WHERE rn>=5""", _SEQUENCES),
)
def sequence_alerts_(spark, sf_dir) -> DataFrame:
    alerts = with_sequences(_live_alerts(spark, sf_dir))
    found = sequence_alerts(alerts, P.fit(alerts))
    return found.withColumns({"events": F.array_join("recent_events", ">"), "sequence": _sequence_text()}).drop("recent_events")


@query(
    "sequence_alerts_global",
    logs("""SELECT d.log_id, d.addr AS source_ip, concat_ws('>', g5, g4, g3, g2, ev) AS events, s.sequence,
            coalesce(b2.next_event, b1.next_event, b0.next_event) AS predicted_next_attack, ev AS current_event, severity
            FROM (SELECT log_id, addr, ev, severity, lag(ev,1) OVER w AS g2, lag(ev,2) OVER w AS g3, lag(ev,3) OVER w AS g4,
                   lag(ev,4) OVER w AS g5 FROM det WINDOW w AS (ORDER BY "timestamp", log_id)) d
            JOIN all_seq s ON s.log_id=d.log_id
            LEFT JOIN best b2 ON b2.length=2 AND b2.context=concat(g2,'>',ev)
            LEFT JOIN best b1 ON b1.length=1 AND b1.context=ev LEFT JOIN best b0 ON b0.length=0
            WHERE g5 IS NOT NULL""", _SEQUENCES),
)
def sequence_alerts_global(spark, sf_dir) -> DataFrame:
    """Correlation records over the window shared by all addresses."""
    found = sequence_alerts(with_sequences(_live_alerts(spark, sf_dir), scope="global"), P.fit(_recent(spark, sf_dir)))
    found = found.withColumn("events", F.array_join("recent_events", ">"))
    return found.select("log_id", "source_ip", "events", _sequence_text(), "predicted_next_attack", "current_event", "severity")


@query("latest_sequences", logs("SELECT addr AS ip, log_id, sequence FROM all_seq WHERE newest=1", _SEQUENCES))
def latest_sequences_(spark, sf_dir) -> DataFrame:
    """The shared window as it stood at the last event of every address."""
    found = latest_sequences(with_sequences(_live_alerts(spark, sf_dir), scope="global"))
    return found.select("ip", "log_id", _sequence_text())


# --- next-event model -------------------------------------------------------------------------------------------------


def _recent(spark, sf_dir, n: int = P.CONTEXT + 1) -> DataFrame:
    rows = soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")
    return with_history(rows, failed=False, recent=n)


@query("markov_transitions", logs("SELECT length, context, next_event, n, support, round(probability,6) AS probability, place=1 AS is_best FROM prob"))
def markov_transitions(spark, sf_dir) -> DataFrame:
    model = P.probabilities(P.transitions(_recent(spark, sf_dir)))
    return model.withColumns({"context": F.array_join("context", ">"), "probability": F.round("probability", 6)})


@query("next_event_predictions", logs("SELECT log_id, predicted_next_attack, round(probability,4) AS confidence, context_length FROM pred"))
def next_event_predictions(spark, sf_dir) -> DataFrame:
    rows = _recent(spark, sf_dir)
    return P.predict(rows, P.fit(rows)).select("log_id", "predicted_next_attack", "confidence", "context_length")


_EVAL_TABLES = """
parts AS (SELECT *, substr(md5(concat_ws('|', log_id, '42')),1,8) < '33333333' AS is_test FROM hist),
t_trans AS (
 SELECT length, context, next_event, count(*) AS n FROM (
  SELECT 0 AS length, '' AS context, e1 AS next_event FROM parts WHERE NOT is_test
  UNION ALL SELECT 1, e2, e1 FROM parts WHERE rn>1 AND NOT is_test
  UNION ALL SELECT 2, concat(e3,'>',e2), e1 FROM parts WHERE rn>2 AND NOT is_test) t GROUP BY ALL
),
t_prob AS (SELECT *, n/support AS probability FROM (
  SELECT *, sum(n) OVER (PARTITION BY length, context) AS support,
   row_number() OVER (PARTITION BY length, context ORDER BY n DESC, next_event) AS place FROM t_trans) t),
t_rows AS (
 SELECT e1, CASE WHEN b2.context IS NOT NULL THEN 2 WHEN b1.context IS NOT NULL THEN 1 ELSE 0 END AS length,
  CASE WHEN b2.context IS NOT NULL THEN b2.context WHEN b1.context IS NOT NULL THEN b1.context ELSE '' END AS context,
  CASE WHEN b2.context IS NOT NULL THEN b2.next_event WHEN b1.context IS NOT NULL THEN b1.next_event ELSE b0.next_event END AS guess
 FROM parts p
 LEFT JOIN t_prob b2 ON b2.support>=5 AND b2.place=1 AND b2.length=2 AND p.rn>2 AND b2.context=concat(p.e3,'>',p.e2)
 LEFT JOIN t_prob b1 ON b1.support>=5 AND b1.place=1 AND b1.length=1 AND b1.context=p.e2
 LEFT JOIN t_prob b0 ON b0.support>=5 AND b0.place=1 AND b0.length=0
 WHERE is_test AND rn>1
)
"""

_EVAL = """SELECT count(*) AS samples, round(avg(CASE WHEN e1=guess THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS accuracy,
 round(-avg(ln(greatest(coalesce(t.probability,0),1e-7::DOUBLE))),6) AS log_loss
FROM t_rows r LEFT JOIN t_prob t ON t.length=r.length AND t.context=r.context AND t.next_event=r.e1
"""


@query("predictor_eval", logs(_EVAL, _EVAL_TABLES))
def predictor_eval(spark, sf_dir) -> DataFrame:
    from palisade.operators.prep import hash_split

    rows = hash_split(_recent(spark, sf_dir), ["log_id"])
    return P.evaluate(rows.filter("part = 'test'"), P.fit(rows.filter("part = 'train'")))


# --- enrichment and response ------------------------------------------------------------------------------------------

_INTEL = "mitre_attack, mitre_tactic, mitre_confidence, recommended_action, threat_intel_method, match_kind"


@query("mitre_enrich", logs(f"SELECT log_id, ev AS event, predicted_next_attack, {_INTEL} FROM enr"))
def mitre_enrich(spark, sf_dir) -> DataFrame:
    alerts = detect(with_history(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip"), recent=5))
    rows = enrich(investigate(alerts, P.fit(alerts)))
    return rows.select("log_id", "event", "predicted_next_attack", *_INTEL.split(", "))


@query(
    "mitre_fuzzy",
    logs("""SELECT log_id, ev AS event, k.technique, k.confidence FROM det d JOIN first_keyword f ON f.kev=d.ev
            JOIN keywords k ON k.prio=f.prio"""),
)
def mitre_fuzzy(spark, sf_dir) -> DataFrame:
    rows = soc_logs(spark, sf_dir).select("log_id", F.coalesce("event", F.lit("unknown")).alias("event"))
    rows = rows.withColumn("entry", keyword_entry(F.col("event"))).filter("entry IS NOT NULL")
    return rows.select("log_id", "event", "entry.technique", "entry.confidence")


def _rule_alerts(spark, sf_dir) -> DataFrame:
    return pipeline.rule_alerts(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip", "user"))


def _predicted_alerts(spark, sf_dir) -> DataFrame:
    return pipeline.predicted_alerts(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip", "user"))


@query(
    "remediation_actions",
    logs("""SELECT d.log_id, d.severity, CAST(count(*) AS INT) AS remediation_count,
            string_agg(concat(a.action,':',a.target), ';' ORDER BY action_no) AS actions
            FROM det d JOIN acts a ON a.log_id=d.log_id GROUP BY d.log_id, d.severity"""),
)
def remediation_actions(spark, sf_dir) -> DataFrame:
    text = F.transform("remediation_actions", lambda a: F.concat(a.action, F.lit(":"), a.target))
    rows = _rule_alerts(spark, sf_dir)
    return rows.select("log_id", "severity", "remediation_count", F.array_join(text, ";").alias("actions"))


@query("remediation_long", logs("SELECT log_id, severity, action_no, action, target, command, event, status, note FROM acts"))
def remediation_long(spark, sf_dir) -> DataFrame:
    return exploded_actions(_rule_alerts(spark, sf_dir))


@query(
    "remediation_log",
    logs("""SELECT r.log_id, ev AS event, severity, ip, "user", mitre_attack AS mitre, a.n AS n_actions FROM rule_enr r
            JOIN (SELECT log_id, CAST(count(*) AS INT) AS n FROM acts GROUP BY log_id) a ON a.log_id=r.log_id"""),
)
def remediation_log(spark, sf_dir) -> DataFrame:
    rows = _rule_alerts(spark, sf_dir)
    log = action_log(rows.withColumn("event", F.struct("log_id", "event")))
    return log.select(
        "event.log_id", "event.event", "severity", "ip", "user", "mitre", F.size("actions").alias("n_actions")
    )


@query(
    "incident_reports",
    logs("""SELECT concat('INC-', upper(substr(md5(CAST(e.log_id AS VARCHAR)),1,8))) AS incident_id, ev AS event, severity, ip,
            "user", "timestamp", 'rule_based' AS detection_method, investigation,
            'sequence_model' AS investigation_method, predicted_next_attack, confidence AS lstm_confidence, mitre_attack,
            mitre_tactic, mitre_confidence, recommended_action, a.n AS remediation_count
            FROM enr e JOIN (SELECT log_id, CAST(count(*) AS INT) AS n FROM acts GROUP BY log_id) a ON a.log_id=e.log_id"""),
)
def incident_reports(spark, sf_dir) -> DataFrame:
    rows = reports(_predicted_alerts(spark, sf_dir))
    return rows.drop("generated_at", "remediated_at", "anomaly_score", "remediation_actions")


@query(
    "alerts_by_severity_tactic",
    logs("""SELECT severity, mitre_tactic, count(*) AS alerts, sum(a.n)::BIGINT AS actions, count(DISTINCT addr) AS addresses
            FROM rule_enr r JOIN (SELECT log_id, count(*) AS n FROM acts GROUP BY log_id) a ON a.log_id=r.log_id
            GROUP BY severity, mitre_tactic"""),
)
def alerts_by_severity_tactic(spark, sf_dir) -> DataFrame:
    """Remediated alerts by severity and tactic: the whole rule chain in one plan."""
    rows = _rule_alerts(spark, sf_dir)
    return rows.groupBy("severity", "mitre_tactic").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.sum("remediation_count").alias("actions"),
        F.count_distinct(KEY).alias("addresses"),
    )


@query(
    "persist_projection",
    logs("""SELECT log_id, 'remediated' AS stage, ev AS event, severity, ip, "user", investigation, mitre_attack,
            predicted_next_attack, CASE WHEN confidence<>0 THEN CAST(confidence AS VARCHAR) END AS confidence,
            CAST(floor("timestamp") AS BIGINT) AS epoch FROM enr"""),
)
def persist_projection(spark, sf_dir) -> DataFrame:
    rows = files.stored_form(_predicted_alerts(spark, sf_dir), "remediated")
    return rows.withColumn("epoch", F.floor(F.col("timestamp").cast("double"))).drop("timestamp", "agent_source")


# --- dashboard --------------------------------------------------------------------------------------------------------


def _stored(spark, sf_dir, made) -> DataFrame:
    """The remediated alerts of an alert table, stored once per application: what the dashboard asks is asked of the table."""
    path = made_once(spark, (sf_dir, made.__name__), lambda path: files.append_alerts(made(spark, sf_dir), path, "remediated"))
    return files.read_alerts(spark, path).filter("stage = 'remediated'")


@query(
    "alert_stats",
    logs("""SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity='CRITICAL') AS critical_count,
            count(*) FILTER (WHERE ev ILIKE '%malware%') AS malware_count FROM det"""),
)
def alert_stats(spark, sf_dir) -> DataFrame:
    return analytics.alert_stats(_stored(spark, sf_dir, _rule_alerts))


@query(
    "severity_chart",
    logs("""SELECT l.severity, l.level, coalesce(n,0) AS count FROM
            (VALUES ('LOW',0),('MEDIUM',1),('HIGH',2),('CRITICAL',3)) l(severity, level)
            LEFT JOIN (SELECT severity, count(*) AS n FROM det GROUP BY severity) c ON c.severity=l.severity"""),
)
def severity_chart(spark, sf_dir) -> DataFrame:
    return analytics.severity_chart(_stored(spark, sf_dir, _rule_alerts))


@query(
    "severity_counts",
    logs("""SELECT l.severity, coalesce(n,0) AS n FROM (VALUES ('LOW'),('MEDIUM'),('HIGH'),('CRITICAL')) l(severity)
            LEFT JOIN (SELECT severity, count(*) AS n FROM det GROUP BY severity) c ON c.severity=l.severity"""),
)
def severity_counts(spark, sf_dir) -> DataFrame:
    counts = analytics.severity_counts(_stored(spark, sf_dir, _rule_alerts))
    return counts.select(F.explode("severity_counts").alias("severity", "n"))


_SUMMARY = """SELECT 'total' AS dimension, 'all' AS value, count(*) AS incidents FROM rule_enr
 UNION ALL SELECT 'severity', l.severity, coalesce(n,0) FROM (VALUES ('LOW'),('MEDIUM'),('HIGH'),('CRITICAL')) l(severity)
  LEFT JOIN (SELECT severity, count(*) AS n FROM rule_enr GROUP BY severity) c ON c.severity=l.severity
 UNION ALL SELECT 'tactic', mitre_tactic, count(*) FROM rule_enr GROUP BY mitre_tactic
 UNION ALL SELECT 'ip', addr, count(*) FROM rule_enr GROUP BY addr"""


@query("incident_summary", logs(_SUMMARY))
def incident_summary(spark, sf_dir) -> DataFrame:
    return analytics.incident_summary(_rule_alerts(spark, sf_dir))


@query("top_ips", logs("SELECT addr AS ip, count(*) AS incidents FROM det GROUP BY addr ORDER BY incidents DESC, ip LIMIT 10"))
def top_ips(spark, sf_dir) -> DataFrame:
    return analytics.top_addresses(soc_logs(spark, sf_dir))


_ISO = """concat(strftime(make_timestamp(CAST(floor("timestamp"*1e6+0.5) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f'), '+00:00')"""


@query(
    "alerts_page",
    logs(f"""SELECT log_id AS id, ev AS event, severity, ip, "user", investigation, mitre_attack, predicted_next_attack,
            CASE WHEN confidence<>0 THEN CAST(confidence AS VARCHAR) END AS confidence, {_ISO} AS "timestamp" FROM enr ORDER BY log_id DESC LIMIT 100 OFFSET 50"""),
)
def alerts_page(spark, sf_dir) -> DataFrame:
    return analytics.page(_stored(spark, sf_dir, _predicted_alerts), limit=100, skip=50)


@query(
    "alerts_page_keyset",
    logs(f"""SELECT log_id AS id, ev AS event, severity, ip, "user", investigation, mitre_attack, predicted_next_attack,
            CASE WHEN confidence<>0 THEN CAST(confidence AS VARCHAR) END AS confidence, {_ISO} AS "timestamp" FROM enr WHERE log_id < 900 ORDER BY log_id DESC LIMIT 500"""),
)
def alerts_page_keyset(spark, sf_dir) -> DataFrame:
    return analytics.page(_stored(spark, sf_dir, _predicted_alerts), limit=5000, before=900)


@query(
    "live_feed",
    logs(f"""SELECT log_id, upper(replace(ev,'_',' ')) AS title, severity, coalesce(ip,'-') AS ip, coalesce("user",'-') AS "user",
            mitre_attack, concat(predicted_next_attack, CASE WHEN confidence<>0 THEN concat(' (', {pct("confidence")}, '%)') ELSE '' END)
             AS next_predicted
            FROM enr ORDER BY "timestamp" DESC, log_id DESC LIMIT 20"""),
)
def live_feed(spark, sf_dir) -> DataFrame:
    return analytics.live_feed(_stored(spark, sf_dir, _predicted_alerts))


@query(
    "recent_predictions",
    logs(f"""SELECT log_id, predicted_next_attack, replace(ev,'_',' ') AS triggered_by, coalesce(ip,'unknown IP') AS ip,
            CASE WHEN confidence<>0 THEN concat({pct("confidence")}, '%') END AS confidence
            FROM (SELECT * FROM enr ORDER BY log_id DESC LIMIT 20) t
            WHERE predicted_next_attack<>'' AND predicted_next_attack<>'BENIGN' ORDER BY log_id DESC LIMIT 5"""),
)
def recent_predictions(spark, sf_dir) -> DataFrame:
    return analytics.recent_predictions(_stored(spark, sf_dir, _predicted_alerts))


def _rates(spark, sf_dir, every, slide=None) -> DataFrame:
    rows = soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip")
    alerts = detect(with_history(rows)).withColumn("ts", C.alert_time(F.col("timestamp")))
    rate = analytics.alert_rate(alerts, every, slide)
    return rate.select(F.unix_timestamp("window_start").alias("window_start"), "severity", "alerts")


_MICROS = 'CAST(floor("timestamp"*1e6+0.5) AS BIGINT)'


@query(
    "alert_rate_tumbling",
    logs(f"""SELECT ({_MICROS}//600000000)*600 AS window_start, severity, count(*) AS alerts FROM det GROUP BY ALL"""),
)
def alert_rate_tumbling(spark, sf_dir) -> DataFrame:
    return _rates(spark, sf_dir, "10 minutes")


@query(
    "alert_rate_sliding",
    logs(f"""SELECT ({_MICROS}//300000000)*300 - s.x*300 AS window_start, severity, count(*) AS alerts
            FROM det, (VALUES (0),(1)) s(x) GROUP BY ALL"""),
)
def alert_rate_sliding(spark, sf_dir) -> DataFrame:
    return _rates(spark, sf_dir, "10 minutes", "5 minutes")


@query(
    "ip_sessions",
    logs("""SELECT addr AS ip, CAST(island AS BIGINT) AS session, min("timestamp") AS session_start,
            max("timestamp") AS session_last, count(*) AS events FROM islands GROUP BY addr, island"""),
)
def ip_sessions(spark, sf_dir) -> DataFrame:
    return analytics.address_sessions(soc_logs(spark, sf_dir))


@query(
    "label_decode",
    logs("""SELECT log_id, CAST(l.k%18 AS INT) AS code, coalesce(c.name, concat('class_', CAST(l.k%18 AS VARCHAR))) AS label,
            coalesce(c.name, 'unknown') AS label_or_unknown FROM soc_logs l LEFT JOIN codes c ON c.code=l.k%18"""),
)
def label_decode(spark, sf_dir) -> DataFrame:
    from palisade.operators.prep import decode
    from palisade.session import inline_table

    mapping = inline_table(spark, fixed.LABEL_CODES, "label string, code int")
    rows = soc_logs(spark, sf_dir).select("log_id", (F.col("k") % 18).alias("code"))
    return decode(decode(rows, mapping), mapping, name="label_or_unknown", unknown="unknown")
