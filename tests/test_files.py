"""Files, tables and session helpers."""

import json
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from palisade import fixed
from palisade.operators import pipeline
from palisade.operators.respond import action_log, reports
from palisade.schemas import STORED_ALERT
from palisade.session import checked_broadcast, durable_dir, inline_table
from palisade.sources import files

LOG = "log_id bigint, timestamp double, event string, ip string, user string"


def alerts(spark, ids):
    rows = [(i, 1704067200.0 + 3600 * i, "port_scan", "a", None) for i in ids]
    return pipeline.rule_alerts(spark.createDataFrame(rows, LOG))


def test_flow_csv_by_header_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text(" Flow Duration, Label\n1.5, BENIGN \nInfinity,Bot\nNaN,\n")
    (tmp_path / "two.csv").write_text("Label, Flow Bytes/s, Flow Duration\nDDoS,oops,2\n")
    got = files.read_flow_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    rows = [(r["Flow Duration"], r["Label"], r["Flow Bytes/s"], r["file_name"]) for r in got.collect()]
    assert rows == [
        (1.5, " BENIGN ", None, "one.csv"),
        (math.inf, "Bot", None, "one.csv"),
        (None, None, None, "one.csv"),
        (2.0, "DDoS", None, "two.csv"),
    ]
    assert files.read_flow_csv(spark, str(tmp_path / "o*.csv")).count() == 3
    both = files.read_flow_csv(spark, str(tmp_path / "*.csv")).select(*got.columns)
    assert sorted(map(repr, both.collect())) == sorted(map(repr, got.collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_flow_csv(spark, str(tmp_path / "none*.csv"))


def test_decode_defaults_and_dead_letters(spark):
    texts = [
        '{"log_id": 1, "event": "port_scan", "timestamp": 5.25, "Flow Duration": 7}',
        '{"log_id": 2, "event": null, "timestamp": "soon", "extra": {"x": 1}}',
        '{"log_id": 3, "ip": "a"',
        "not json",
        '{"event": "x"}',
        None,
    ]
    records = spark.createDataFrame([(t,) for t in texts], "value string")
    good, dead = files.split_dead_letters(files.decode_logs(records))
    got = [(r["log_id"], r["event"], r["timestamp"], r["Flow Duration"]) for r in good.orderBy("log_id").collect()]
    assert got[0][0] < 0 and got[0][1:] == ("x", None, None)  # named by its text
    assert got[1:] == [(1, "port_scan", 5.25, 7.0), (2, None, None, None)]
    causes = sorted((r["cause"], r["record"] or "") for r in dead.collect())
    assert causes == [("malformed", ""), ("malformed", "not json"), ("malformed", '{"log_id": 3, "ip": "a"')]


def test_encode_writes_unusual_types_as_text(spark):
    row = spark.createDataFrame([(1, None)], "a int, b string").withColumn("t", F.lit("2024-01-01").cast("date"))
    assert json.loads(files.encode_json(row).first()[0]) == {"a": 1, "t": "2024-01-01"}


def test_append_is_idempotent_per_stage(spark, tmp_path):
    path = str(tmp_path / "alerts")
    files.append_alerts(alerts(spark, range(10)), path, "remediated")
    files.append_alerts(alerts(spark, range(5, 40)), path, "remediated")
    files.append_alerts(alerts(spark, range(3)), path, "detected")
    stored = files.read_alerts(spark, path)
    assert {(r["stage"], r["count"]) for r in stored.groupBy("stage").count().collect()} == {("remediated", 40), ("detected", 3)}
    assert stored.select("log_id", "stage").distinct().count() == 43


def test_stored_form(spark):
    rows = [(1, None, None, 0.0, "x"), (2, "e", "HIGH", 0.25, "7.5"), (3, "e", "HIGH", None, None)]
    df = spark.createDataFrame(rows, "log_id bigint, event string, severity string, confidence double, timestamp string")
    got = files.stored_form(df, "detected").orderBy("log_id").collect()
    assert [(r["event"], r["severity"], r["confidence"], r["ip"]) for r in got] == [
        ("unknown", "LOW", None, None), ("e", "HIGH", "0.25", None), ("e", "HIGH", None, None),
    ]
    assert got[1]["timestamp"].timestamp() == 7.5


def test_old_table_files_gain_columns(spark, tmp_path):
    path = str(tmp_path / "alerts")
    old = alerts(spark, range(3)).select("log_id", "event", "severity")
    old = old.withColumns({"stage": F.lit("remediated"), "day": F.lit("2024-01-01")})
    old.write.partitionBy("stage", "day").parquet(path)
    files.append_alerts(alerts(spark, range(6)), path, "remediated")
    got = files.read_alerts(spark, path).orderBy("log_id").collect()
    assert [(r["log_id"], r["ip"]) for r in got] == [(0, None), (1, None), (2, None), (3, "a"), (4, "a"), (5, "a")]
    assert files.add_missing_columns(old).schema.simpleString().count("predicted_next_attack") == 1
    assert set(STORED_ALERT.names) <= set(files.add_missing_columns(old).columns)


def test_logs_reports_and_mappings(spark, tmp_path):
    done = alerts(spark, range(6))
    log = action_log(done)
    files.append_action_log(log, str(tmp_path / "log"))
    files.append_action_log(log, str(tmp_path / "log"))
    assert spark.read.schema(log.schema).json(str(tmp_path / "log")).count() == 12
    files.write_reports(reports(done), str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).select("incident_id").distinct().count() == 6
    mapping = inline_table(spark, fixed.LABEL_CODES, "label string, code int")
    files.write_mapping(mapping, str(tmp_path / "mapping"))
    back = files.read_mapping(spark, str(tmp_path / "mapping"))
    assert {tuple(r) for r in back.select("label", "code").collect()} == set(fixed.LABEL_CODES)
    assert {r["label"]: r["code"] for r in files.severity_mapping(spark).collect()} == fixed.SEVERITY_CODES


def test_inline_table_keeps_values(spark):
    rows = [("it's", 1.5, None), ("back\\slash", math.inf, 7), ("–�", -0.25, 0)]
    assert [tuple(r) for r in inline_table(spark, rows, "a string, b double, c bigint").collect()] == rows
    assert inline_table(spark, [], "a string").count() == 0
    assert inline_table(spark, [(i,) for i in range(3000)], "a bigint").count() == 3000


def test_lookup_is_broadcast_only_when_small(spark):
    df = spark.range(50)
    hinted = checked_broadcast(df)._jdf.queryExecution().toString()
    plain = checked_broadcast(df, max_rows=10)._jdf.queryExecution().toString()
    assert "strategy=broadcast" in hinted and "strategy=broadcast" not in plain


def test_durable_dir_follows_the_session():
    def fake(conf, master="spark://host:7077", checkpoint=None):
        context = SimpleNamespace(
            getConf=lambda: {}, getCheckpointDir=lambda: checkpoint, master=master, applicationId="fake-app"
        )
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)

    assert durable_dir(fake({"spark.checkpoint.dir": "s3a://shared/dir/"})) == "s3a://shared/dir"
    assert durable_dir(fake({}, checkpoint="hdfs://shared/c")) == "hdfs://shared/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable_dir(fake({}))
    assert durable_dir(fake({}, master="local[2]")) == durable_dir(fake({}, master="local[2]"))


def test_facts_are_taken_of_the_written_sequences(spark, tmp_path):
    made = spark.range(7).selectExpr("cast(id as int) as y")
    seen = []

    def facts(written):
        seen.append(written.inputFiles())
        return written.selectExpr("count(*) as dataset_size", "max(y) as top")

    files.write_sequences(made, facts, str(tmp_path / "s"))
    read, found = files.read_sequences(spark, str(tmp_path / "s"))
    assert found == {"dataset_size": 7, "top": 6} and read.count() == 7
    assert seen[0] and all("/s/windows/" in f for f in seen[0])
