"""Queries through files: CSV, JSON, the alert table, schema evolution and dead letters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import fixed
from palisade.operators import pipeline, prep, sequences
from palisade.operators.respond import action_log, reports
from palisade.plans.flows import FEATURES, SHORT, rounded_features, shown_key, window_text
from palisade.plans.logs import _SUMMARY
from palisade.plans.registry import query
from palisade.plans.sql import SHOWN_KEY, flows, logs, near, windows
from palisade.session import materialize, new_path
from palisade.sources import files
from palisade.sources.adapters import FLOW_KEY, network_flows, soc_logs


def _alerts(spark, sf_dir) -> DataFrame:
    return pipeline.rule_alerts(soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip", "user"))


@query(
    "csv_scan",
    flows("""SELECT "Label" AS label, count(*) AS n, count("Flow Bytes/s") AS with_bytes,
             count(*) FILTER (WHERE isinf("Flow Packets/s")) AS infinite, round(sum("Flow Duration"),2) AS duration
             FROM flows GROUP BY "Label" """),
)
def csv_scan(spark, sf_dir) -> DataFrame:
    """The flows as CSV files with blanks around the header names, read back by header name."""
    path = new_path(spark, "flow-csv")
    rows = network_flows(spark, sf_dir).select(*FEATURES, "Label", "file_id")
    padded = rows.toDF(*[f" {c} " if c != "file_id" else c for c in rows.columns])
    padded.write.partitionBy("file_id").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    read = files.read_flow_csv(spark, [f"{path}/file_id={i}" for i in range(8)])
    return read.groupBy(F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("`Flow Bytes/s`").alias("with_bytes"),
        F.count_if(F.abs("Flow Packets/s") == float("inf")).alias("infinite"),
        F.round(F.sum("Flow Duration"), 2).alias("duration"),
    )


@query(
    "csv_glob",
    flows("""SELECT "Label" AS label, count(*) AS n, count("Flow Bytes/s") AS with_bytes,
             count(*) FILTER (WHERE isinf("Flow Packets/s")) AS infinite, round(sum("Flow Duration"),2) AS duration,
             round(sum("Total Fwd Packets"),2) AS packets FROM flows GROUP BY "Label" """),
)
def csv_glob(spark, sf_dir) -> DataFrame:
    """The flows as CSV files of two column orders, read by one glob, each by its own header."""
    path = new_path(spark, "flow-globs")
    rows = network_flows(spark, sf_dir).select(*FEATURES, "Label", "file_id")
    for order, half in ((FEATURES + ["Label"], 0), (["Label"] + FEATURES[::-1], 1)):
        writer = rows.where(F.col("file_id") % 2 == half).select(*order).write.option("header", True)
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/order={half}")
    read = files.read_flow_csv(spark, f"{path}/*/*.csv")
    return read.groupBy(F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("`Flow Bytes/s`").alias("with_bytes"),
        F.count_if(F.abs("Flow Packets/s") == float("inf")).alias("infinite"),
        F.round(F.sum("Flow Duration"), 2).alias("duration"),
        F.round(F.sum("Total Fwd Packets"), 2).alias("packets"),
    )


@query("parquet_round_trip", flows(f"""SELECT {SHOWN_KEY}, part, "Flow Bytes/s" AS bytes, "Label" AS label FROM splits"""))
def parquet_round_trip(spark, sf_dir) -> DataFrame:
    """The two split parts written as tables and read back as one."""
    parts = prep.stratified_split(network_flows(spark, sf_dir), FLOW_KEY)
    path = new_path(spark, "split")
    parts.write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).select(*shown_key(), "part", F.col("Flow Bytes/s").alias("bytes"), F.col("Label").alias("label"))


@query(
    "severity_csv",
    flows("""SELECT severity, count(*) AS n, round(sum("Flow Bytes/s"),2) AS bytes FROM (SELECT *,
             CASE WHEN trim("Label")='BENIGN' THEN 'LOW' WHEN contains("Label",'PortScan') THEN 'MEDIUM'
              WHEN contains("Label",'Web Attack') OR contains("Label",'Infiltration') THEN 'HIGH'
              WHEN contains("Label",'DDoS') OR contains("Label",'Bot') THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity
             FROM zeroed WHERE "Flow Bytes/s" IS NOT NULL) t GROUP BY severity"""),
)
def severity_csv(spark, sf_dir) -> DataFrame:
    made = prep.severity_dataset(network_flows(spark, sf_dir)).select(*fixed.SEVERITY_SET_FEATURES, "severity")
    path = new_path(spark, "severity-csv")
    files.write_csv(made, path)
    read = files.read_csv(spark, path, made.schema)
    return read.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Flow Bytes/s"), 2).alias("bytes"))


@query("json_round_trip", logs("""SELECT log_id, event, ip, "user", "timestamp", flow_duration FROM soc_logs"""))
def json_round_trip(spark, sf_dir) -> DataFrame:
    """Log rows encoded as JSON text and decoded again."""
    encoded = files.encode_json(soc_logs(spark, sf_dir).drop("k"))
    decoded = files.decode_logs(encoded)
    return decoded.select("log_id", "event", "ip", "user", "timestamp", F.col("Flow Duration").alias("flow_duration"))


@query(
    "dead_letter",
    logs("""SELECT log_id, CASE WHEN k%10=0 THEN 'malformed' WHEN k%10=1 THEN 'derived_id' ELSE 'good' END AS outcome,
            CASE WHEN k%10<>0 AND k%10<>2 THEN "timestamp" END AS "timestamp" FROM soc_logs WHERE k%10>1
            UNION ALL SELECT NULL, CASE WHEN k%10=0 THEN 'malformed' ELSE 'derived_id' END, CASE WHEN k%10=1 THEN "timestamp" END
            FROM soc_logs WHERE k%10<2"""),
)
def dead_letter(spark, sf_dir) -> DataFrame:
    """Records of which some are cut off, lack their id or carry a timestamp that is no number."""
    kind = F.col("k") % 10
    rows = soc_logs(spark, sf_dir).withColumn("time", F.when(kind == 2, F.lit("soon")).otherwise(F.col("timestamp").cast("string")))
    text = F.to_json(F.struct(F.when(kind != 1, F.col("log_id")).alias("log_id"), "event", "ip", F.col("time").alias("timestamp")))
    text = F.when(kind == 0, F.substring(text, 1, 12)).otherwise(text)
    good, dead = files.split_dead_letters(files.decode_logs(rows.select(text.alias("value"))))
    outcome = F.when(F.col("log_id") < 0, "derived_id").otherwise("good")
    return good.select(F.when(F.col("log_id") >= 0, F.col("log_id")).alias("log_id"), outcome.alias("outcome"), "timestamp").unionByName(
        dead.select(F.lit(None).cast("bigint").alias("log_id"), F.col("cause").alias("outcome"), F.lit(None).cast("double").alias("timestamp"))
    )


@query(
    "schema_evolve",
    logs("""SELECT log_id, event, severity, CASE WHEN k>=50 THEN ip END AS ip, CASE WHEN k>=50 THEN mitre_attack END AS mitre_attack
            FROM (SELECT log_id, ev AS event, severity, ip, mitre_attack, k FROM rule_enr) t"""),
)
def schema_evolve(spark, sf_dir) -> DataFrame:
    """Alerts of an older table without address and technique, stacked with current ones."""
    rows = soc_logs(spark, sf_dir).select("log_id", "timestamp", "event", "ip", "user", "k")
    alerts = pipeline.rule_alerts(rows).select("log_id", "event", "severity", "ip", "mitre_attack", "k")
    older = alerts.filter("k < 50").select("log_id", "event", "severity")
    schema = T.StructType([f for f in alerts.schema.fields if f.name != "k"])
    current = alerts.filter("k >= 50").drop("k")
    return files.add_missing_columns(older, schema).unionByName(current)


TWO_STAGES = """SELECT log_id, 'remediated' AS stage, ev AS event, severity, ip, "user", investigation, mitre_attack FROM rule_enr
 UNION ALL SELECT log_id, 'detected', ev, severity, ip, "user", NULL, NULL FROM rule_enr"""


@query("alert_store", logs(TWO_STAGES))
def alert_store(spark, sf_dir) -> DataFrame:
    """Alerts of both stages, a fifth without a time, appended in two parts, one of them twice: each is stored once."""
    alerts = _alerts(spark, sf_dir).withColumn("timestamp", F.when(F.col("log_id") % 5 != 0, F.col("timestamp")))
    alerts = materialize(alerts, "alerts")
    path = new_path(spark, "alerts")
    for stage in ("detected", "remediated"):
        files.append_alerts(alerts.filter("log_id % 3 <> 0"), path, stage)
        files.append_alerts(alerts, path, stage)
    stored = files.read_alerts(spark, path)
    return stored.select("log_id", "stage", "event", "severity", "ip", "user", "investigation", "mitre_attack")


@query(
    "action_log_files",
    logs("SELECT severity, mitre_attack AS mitre, action, count(*) AS n FROM acts a JOIN (SELECT log_id, mitre_attack FROM rule_enr) r USING (log_id) GROUP BY ALL"),
)
def action_log_files(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "action-log")
    log = action_log(_alerts(spark, sf_dir))
    files.append_action_log(log, path)
    read = spark.read.schema(log.schema).json(path)
    rows = read.select("severity", "mitre", F.explode("actions.action").alias("action"))
    return rows.groupBy("severity", "mitre", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_files",
    logs("""SELECT concat('INC-', upper(substr(md5(CAST(log_id AS VARCHAR)),1,8))) AS incident_id, severity, ev AS event, mitre_tactic
            FROM rule_enr"""),
)
def report_files(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "reports")
    made = reports(_alerts(spark, sf_dir))
    files.write_reports(made, path)
    return spark.read.schema(made.schema).json(path).select("incident_id", "severity", "event", "mitre_tactic")


@query("summary_snapshot", logs(_SUMMARY))
def summary_snapshot(spark, sf_dir) -> DataFrame:
    from palisade.operators.analytics import incident_summary

    path = new_path(spark, "summary")
    files.write_summary(incident_summary(_alerts(spark, sf_dir)), path)
    return spark.read.parquet(path).drop("last_updated")


@query("mapping_files", flows("SELECT class AS label, code FROM mapping"))
def mapping_files(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "mapping")
    files.write_mapping(prep.label_mapping(network_flows(spark, sf_dir)), path)
    return files.read_mapping(spark, path)


@query("sequence_files", flows(windows("PARTITION BY file_id")))
def sequence_files(spark, sf_dir) -> DataFrame:
    """Training windows and their facts written and read back; the facts have to match the windows."""
    made, classes = sequences.dataset(network_flows(spark, sf_dir))
    path = new_path(spark, "sequences")
    files.write_sequences(made, lambda written: sequences.metadata(written, classes), path)
    read, facts = files.read_sequences(spark, path)
    if (facts["sequence_length"], facts["dataset_size"]) != (fixed.SEQUENCE_LENGTH, read.count()):
        raise ValueError(f"windows do not match their metadata: {facts}")
    return read.select(*shown_key(), "y", window_text(F.col("seq")).alias("seq_md5"))


@query(
    "preprocess_flows",
    flows(f"""SELECT {SHOWN_KEY}, code AS label_code, {", ".join(near(f'coalesce("{c}", m_{s})', 4) + f" AS {s}" for c, s in zip(FEATURES, SHORT))}
              FROM labelled JOIN mapping ON class="Label",
              (SELECT {", ".join(f'quantile_cont("{c}", 0.5) AS m_{s}' for c, s in zip(FEATURES, SHORT))} FROM labelled) m"""),
)
def preprocess_flows(spark, sf_dir) -> DataFrame:
    """The cleaned data set: infinities and nulls filled with medians, labels coded, written as a table and read back."""
    path = new_path(spark, "processed")
    prep.preprocess(network_flows(spark, sf_dir), keys=[*FLOW_KEY, "file_id"]).write.parquet(path)
    return spark.read.parquet(path).select(*shown_key(), "label_code", *rounded_features(4))
