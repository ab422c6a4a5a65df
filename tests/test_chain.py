"""The alert chain on literal rows."""

from pyspark.sql import functions as F

from palisade import fixed
from palisade.operators import analytics, pipeline
from palisade.operators import predict as P
from palisade.operators.detect import detect, flow_vectors, with_history
from palisade.operators.intel import enrich
from palisade.operators.investigate import investigate, padded_sequence, sequence_alerts, sequence_features, with_sequences
from palisade.operators.respond import exploded_actions, reports, respond

LOG = "log_id bigint, timestamp double, event string, ip string, user string"


def logs(spark, rows):
    return spark.createDataFrame([(i, float(t), e, ip, u) for i, (t, e, ip, u) in enumerate(rows)], LOG)


def test_failed_login_escalation(spark):
    rows = [(i, "failed_login", "a", "u") for i in range(8)]
    rows += [(20, "failed_login", None, "u"), (21, "failed_login", "", "u"), (22, "port_scan", "a", "u")]
    got = {r["log_id"]: r for r in detect(with_history(logs(spark, rows))).collect()}
    assert [got[i]["failed_login_count"] for i in range(8)] == list(range(1, 9))
    assert [got[i]["severity"] for i in range(8)] == ["LOW"] * 5 + ["HIGH"] * 3
    assert [got[i]["failed_login_count"] for i in (8, 9, 10)] == [None] * 3
    assert got[10]["severity"] == "MEDIUM"


def test_frequency_restarts_after_silence(spark):
    rows = [(0, "x", "a", None), (3600, "x", "a", None), (7200.5, "x", "a", None), (7201, "x", "a", None), (0, "x", None, None)]
    got = with_history(logs(spark, rows), frequency=True).orderBy("log_id").collect()
    assert [r["attack_frequency"] for r in got] == [1, 2, 1, 2, 1]


def test_missing_event_is_unknown(spark):
    got = detect(with_history(logs(spark, [(0, None, "a", None)]))).first()
    assert (got["event"], got["severity"], got["detection_method"]) == ("unknown", "LOW", "rule_based")


def test_forest_columns_replace_the_rules(spark):
    rows = with_history(logs(spark, [(0, "malware_detected", "a", None)]))
    scored = rows.withColumns({"anomaly_prediction": F.lit(-1), "anomaly_score": F.lit(-0.123456)})
    got = detect(scored).first()
    assert (got["severity"], got["anomaly_score"], got["detection_method"]) == ("MEDIUM", -0.1235, "isolation_forest")


def test_flow_vectors(spark):
    rows = spark.createDataFrame(
        [(1, "port_scan", 7.0), (2, "port_scan", None), (3, "odd", None), (4, None, 1.0)], "log_id int, event string, d double"
    ).withColumnRenamed("d", "Flow Duration")
    for name in fixed.FLOW_FEATURES[1:]:
        rows = rows.withColumn(name, F.lit(None).cast("double"))
    got = {r["log_id"]: r["features"] for r in flow_vectors(rows).collect()}
    defaults = {e: [float(x) for x in v] for e, v in fixed.EVENT_FLOW_DEFAULTS}
    assert got[1] == [7.0] + defaults["port_scan"][1:]
    assert got[2] == defaults["port_scan"]
    assert got[3] == defaults["unknown"]
    assert got[4] == [1.0] + defaults["unknown"][1:]


def test_sequence_is_padded_in_front(spark):
    rows = logs(spark, [(i, "ddos_attempt", "a", None) for i in range(7)])
    got = with_history(rows, recent=5).select("log_id", padded_sequence(F.col("recent_events")).alias("s")).orderBy("log_id")
    sequences = [r["s"] for r in got.collect()]
    vector = [float(v) for v in dict(fixed.EVENT_VECTORS)["ddos_attempt"]]
    assert sequences[0] == [[0.0] * 6] * 4 + [vector]
    assert sequences[6] == [vector] * 5


def intel(spark, rows):
    df = spark.createDataFrame(rows, "event string, predicted_next_attack string")
    return {(r["event"], r["predicted_next_attack"]): r for r in enrich(df).collect()}


def test_every_technique_matches_exactly(spark):
    got = intel(spark, [(t[0], "DDoS") for t in fixed.TECHNIQUES])
    for name, technique, tactic, confidence, action in fixed.TECHNIQUES:
        r = got[name, "DDoS"]
        found = (r["mitre_attack"], r["mitre_tactic"], r["mitre_confidence"], r["recommended_action"])
        assert found == (technique, tactic, confidence, action)
        assert (r["threat_intel_method"], r["match_kind"]) == ("exact_match", "exact")


def test_every_technique_matches_as_prediction(spark):
    got = intel(spark, [("odd_scan", t[0]) for t in fixed.TECHNIQUES])
    for name, technique, _, confidence, _ in fixed.TECHNIQUES:
        r = got["odd_scan", name]
        assert (r["mitre_attack"], r["mitre_confidence"]) == (technique, round(confidence * 0.85, 2))
        assert r["threat_intel_method"] == f"Mapped via LSTM-predicted attack: {name}"


def test_every_keyword(spark):
    got = intel(spark, [(f"Odd_{k[0].upper()}_x", "BENIGN") for k in fixed.KEYWORD_TECHNIQUES] + [("nothing", None)])
    for keyword, technique, tactic, confidence, _ in fixed.KEYWORD_TECHNIQUES:
        r = got[f"Odd_{keyword.upper()}_x", "BENIGN"]
        # "dos" stands before "ddos" and is part of it
        first = "dos" if keyword == "ddos" else keyword
        assert (r["mitre_attack"], r["mitre_tactic"]) == (technique, tactic)
        assert r["threat_intel_method"] == f"Fuzzy-matched on keyword '{first}' — confidence reduced."
        assert r["mitre_confidence"] == (0.6 if keyword == "ddos" else confidence)
    r = got["nothing", None]
    assert (r["mitre_attack"], r["mitre_confidence"], r["threat_intel_method"], r["match_kind"]) == (
        fixed.UNKNOWN_TECHNIQUE[0], 0.3, "exact_match", "unknown",
    )


def test_actions_per_tier(spark):
    rows = [
        (1, "CRITICAL", "e", "1.1.1.1", "bob"),
        (2, "CRITICAL", "e", None, None),
        (3, "HIGH", "e", "1.1.1.1", "bob"),
        (4, "HIGH", "e", "1.1.1.1", "unknown"),
        (5, "MEDIUM", "e", "1.1.1.1", "bob"),
        (6, "LOW", None, None, "bob"),
        (7, None, "e", "1.1.1.1", ""),
    ]
    df = spark.createDataFrame(rows, "log_id int, severity string, event string, ip string, user string")
    done = respond(df)
    got = {}
    for r in exploded_actions(done).orderBy("log_id", "action_no").collect():
        got.setdefault(r["log_id"], []).append(r)
    assert [[a["action"] for a in got[i]] for i in range(1, 8)] == [
        ["BLOCK_IP", "ISOLATE_USER", "ESCALATE_TO_ANALYST"],
        ["BLOCK_IP", "ESCALATE_TO_ANALYST"],
        ["BLOCK_IP", "FLAG_USER_FOR_REVIEW"],
        ["BLOCK_IP"],
        ["RATE_LIMIT_IP", "INCREASE_MONITORING"],
        ["AUDIT_LOG"],
        ["AUDIT_LOG"],
    ]
    assert got[1][0]["command"] == "iptables -A INPUT -s 1.1.1.1 -j DROP"
    assert got[1][1]["command"] == "usermod --lock bob"
    assert (got[1][2]["status"], got[1][2]["note"]) == ("triggered", "CRITICAL alert for 'e' — paging on-call analyst.")
    assert got[2][0]["target"] == "unknown"
    assert (got[6][0]["event"], got[6][0]["target"]) == ("unknown", "unknown")
    counts = {r["log_id"]: r["remediation_count"] for r in done.collect()}
    assert counts == {i: len(got[i]) for i in counts}


def test_reports_have_defaults(spark):
    done = pipeline.rule_alerts(logs(spark, [(5, None, None, None)]))
    r = reports(done).first()
    assert (r["event"], r["severity"], r["ip"], r["timestamp"], r["remediation_count"]) == ("unknown", "LOW", None, 5.0, 1)
    assert r["incident_id"].startswith("INC-") and len(r["incident_id"]) == 12


def test_prediction_backs_off(spark):
    rows = logs(spark, [(i, "abc"[i % 3], "p", None) for i in range(60)] + [(0, "zzz", "q", None)])
    recent = with_history(rows, recent=5)
    model = P.fit(recent)
    got = {r["log_id"]: r for r in P.predict(recent, model).collect()}
    assert (got[30]["predicted_next_attack"], got[30]["confidence"], got[30]["context_length"]) == ("b", 1.0, 2)
    assert (got[0]["predicted_next_attack"], got[0]["context_length"]) == ("b", 1)
    assert (got[60]["predicted_next_attack"], got[60]["context_length"]) == ("a", 0)
    quality = P.evaluate(recent, model).first()
    assert (quality["samples"], quality["accuracy"], quality["log_loss"]) == (59, 1.0, 0.0)
    told = investigate(detect(recent), model).filter("log_id = 30").first()
    assert told["investigation"] == (
        "Unknown attack pattern predicted: 'b' — manual analyst review required. (N-gram model predicted 'b' with 100.0% "
        "confidence based on last 5 events from p.)"
    )


def test_sequence_alerts_wait_for_a_full_window(spark):
    recent = with_sequences(detect(with_history(logs(spark, [(i, "port_scan", "a", None) for i in range(9)]), frequency=True)))
    got = sequence_alerts(recent, P.fit(recent)).orderBy("log_id").collect()
    assert [r["log_id"] for r in got] == [4, 5, 6, 7, 8]
    # the live features of the five events, with the frequency that each of them had
    assert got[0]["sequence"] == [[0, 1, 0.4, 100, n, int(n > 3)] for n in range(1, 6)]
    assert {(r["source_ip"], r["current_event"], r["predicted_next_attack"], r["type"]) for r in got} == {
        ("a", "port_scan", "port_scan", "sequence_correlation")
    }


def test_live_sequence_features(spark):
    rows = logs(spark, [(i, "failed_login", "a", None) for i in range(6)] + [(9, "port_scan", "b", None)])
    alerts = detect(with_history(rows, frequency=True)).drop("anomaly_score")
    got = sequence_features(alerts).orderBy("log_id").select("log_id", *fixed.SEQUENCE_FEATURES).collect()
    assert tuple(got[5])[1:] == (0, 2, 0.9, 600, 6, 1)
    assert tuple(got[6])[1:] == (0, 1, 0.4, 100, 1, 0)
    codes = spark.createDataFrame([("port_scan", 9)], "label string, code int")
    assert sequence_features(alerts, codes).filter("log_id = 6").first()["attack_encoded"] == 9


def test_dashboard_levels_and_page(spark):
    rows = [(i, "CRITICAL" if i % 2 else "ODD", "Big_MALWARE") for i in range(700)]
    alerts = spark.createDataFrame(rows, "log_id bigint, severity string, event string")
    assert tuple(analytics.alert_stats(alerts).first()) == (700, 350, 700)
    chart = analytics.severity_chart(alerts).collect()
    assert [(r["severity"], r["count"]) for r in chart] == [("LOW", 0), ("MEDIUM", 0), ("HIGH", 0), ("CRITICAL", 350)]
    counts = analytics.severity_counts(alerts).first()[0]
    assert counts == {"LOW": 0, "MEDIUM": 0, "HIGH": 0, "CRITICAL": 350, "ODD": 350}
    full = alerts
    for c in ("ip", "user", "investigation", "mitre_attack", "predicted_next_attack", "confidence"):
        full = full.withColumn(c, F.lit(None).cast("string"))
    full = full.withColumn("timestamp", F.lit(0.0))
    assert [r["id"] for r in analytics.page(full, limit=1000).collect()] == list(range(699, 199, -1))
    assert [r["id"] for r in analytics.page(full, limit=2, skip=3).collect()] == [696, 695]
    assert [r["id"] for r in analytics.page(full, limit=2, before=10).collect()] == [9, 8]


def test_recent_predictions_cut_before_filtering(spark):
    rows = [(i, "e_v", None, "Bot" if i % 10 == 0 else "BENIGN", 0.5) for i in range(40)]
    schema = "log_id bigint, event string, ip string, predicted_next_attack string, confidence double"
    got = analytics.recent_predictions(spark.createDataFrame(rows, schema)).collect()
    assert [(r["log_id"], r["triggered_by"], r["ip"], r["confidence"]) for r in got] == [
        (30, "e v", "unknown IP", "50.0%"), (20, "e v", "unknown IP", "50.0%"),
    ]


def test_large_models_are_joined_without_hot_keys(spark, monkeypatch):
    rows = [(i, ["a", "b"] if i % 3 else [f"x{i % 40}", f"y{i % 7}"]) for i in range(900)]
    rows += [(i, e) for i, e in enumerate([[], None, ["b"], ["a", "b", "new"], ["\0", "b"]], 1000)]
    recent = spark.createDataFrame(rows, "log_id long, recent_events array<string>")
    model = P.fit(recent)

    def found():
        names = ["log_id", "predicted_next_attack", "confidence", "context_length"]
        return sorted(map(tuple, P.predict(recent, model, min_support=2).select(*names).collect()))

    want = found()
    monkeypatch.setattr(P, "BROADCAST_CONTEXTS", 0)
    assert len(want) == len(rows) and found() == want
    monkeypatch.setattr(P, "HOT_SHARE", 2)
    assert found() == want
