"""The log and flow tables, derived from the given parquet tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.fixed import FLOW_FEATURES

# Total orders: no two rows share these values.
LOG_ORDER = ["timestamp", "log_id"]
FLOW_KEY = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone; plain interval arithmetic, so no session zone enters."""
    since = ts - F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    hours = F.extract(F.lit("DAY"), since) * 24 + F.extract(F.lit("HOUR"), since)
    minutes = hours * 60 + F.extract(F.lit("MINUTE"), since)
    micros = minutes.cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    return micros / F.lit(1e6)


def _name_by_k(*ranges: tuple[int, str]) -> Column:
    chosen = None
    for below, name in ranges:
        test = F.col("k") < below
        chosen = F.when(test, F.lit(name)) if chosen is None else chosen.when(test, F.lit(name))
    return chosen


def soc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security log events from `events`: log_id, event, ip, user, timestamp and the optional flow features."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    kind = F.col("event_type")
    event = (
        F.when(kind == "error", F.lit("failed_login"))
        .when(kind == "view", F.lit("port_scan"))
        .when(kind == "click", _name_by_k((70, "ddos_attempt"), (100, "brute_force_burst")))
        .when(kind == "signup", _name_by_k((70, "unauthorized_access"), (85, "privilege_audit"), (100, "remote_access_probe")))
        .when(
            kind == "purchase",
            _name_by_k(
                (40, "malware_detected"),
                (80, "privilege_escalation"),
                (90, "sql_injection_probe"),
                (95, "Malware_Beacon"),
                (99, "heartbeat"),
            ),
        )
    )
    user = F.col("user_id")
    address = F.concat(F.lit("10.0."), (user % 4).cast("string"), F.lit("."), (user % 20).cast("string"))
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("k"),
        event.alias("event"),
        F.when(F.col("k") != 7, address).alias("ip"),
        F.when(F.col("k") % 10 != 3, F.concat(F.lit("user_"), user.cast("string"))).alias("user"),
        epoch_seconds(F.col("ts")).alias("timestamp"),
        F.when(F.col("k") % 2 == 1, F.col("value") * 100).alias("Flow Duration"),
        *[F.lit(None).cast("double").alias(name) for name in FLOW_FEATURES[1:]],
    )


_LABEL_BY_PART = [
    " BENIGN ",
    "Bot",
    "DDoS",
    "DoS GoldenEye",
    "DoS Hulk",
    "DoS Slowhttptest",
    "DoS slowloris",
    "FTP-Patator",
    "Heartbleed",
    "Infiltration",
    "PortScan",
    "SSH-Patator",
    "Web Attack - Brute Force",
    "Web Attack - XSS",
]


def network_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network flows from `lineitem`: the ten flow features with infinities and nulls, a label and a file number."""
    inf = F.lit(float("inf"))
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    line = F.col("l_linenumber").cast("double")
    part = F.col("l_partkey") % 40
    label = F.when(part < 25, F.lit("BENIGN"))
    for i, name in enumerate(_LABEL_BY_PART):
        label = label.when(part == 25 + i, F.lit(name))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        *FLOW_KEY,
        (F.col("l_suppkey") % 8).alias("file_id"),
        price.alias("Flow Duration"),
        qty.alias("Total Fwd Packets"),
        line.alias("Total Backward Packets"),
        F.when(F.col("l_partkey") % 50 == 1, F.lit(None))
        .when(F.col("l_discount") == 0, inf)
        .otherwise(F.try_divide(price, F.col("l_discount")))
        .alias("Flow Bytes/s"),
        F.when(F.col("l_tax") == 0, inf).otherwise(F.try_divide(qty, F.col("l_tax"))).alias("Flow Packets/s"),
        F.try_divide(price, qty).alias("Fwd Packet Length Mean"),
        F.try_divide(price, line).alias("Bwd Packet Length Mean"),
        (line % 2).alias("SYN Flag Count"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("ACK Flag Count"),
        F.try_divide(price, qty + line).alias("Average Packet Size"),
        label.alias("Label"),
    )
