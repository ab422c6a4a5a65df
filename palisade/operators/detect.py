"""Detection: history of an address, severity, brute-force escalation, alert rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed
from palisade.functions import columns as C
from palisade.operators.ordered import HOT_ROWS, by_heat
from palisade.session import inline_table
from palisade.sources.adapters import LOG_ORDER

KEY = "_address"


def with_address(logs: DataFrame) -> DataFrame:
    """Add the non-null address key: events without an address are pooled under 'unknown'."""
    return logs.withColumn(KEY, C.or_unknown(F.col("ip")))


def is_failed_login(event: str = "event", ip: str = "ip") -> Column:
    return (F.col(event) == fixed.FAILED_LOGIN) & F.col(ip).isNotNull() & (F.col(ip) != "")


def with_history(
    logs: DataFrame,
    failed: bool = True,
    frequency: bool = False,
    recent: int = 0,
    hot: DataFrame | list | None = None,
    limit: int = HOT_ROWS,
    ttl: float = fixed.FREQUENCY_TTL_SECONDS,
) -> DataFrame:
    """Per-address history in event order, in one exchange for cold addresses.

    failed     failed_login_count: running count on failed logins that carry an address
    frequency  attack_frequency: events since the address was last silent for more than `ttl` seconds
    recent     recent_events: the last `recent` events of the address, the current one last
    """

    def steps(rows, windows):
        if failed:
            rows = windows.running_count(rows, "failed_login_count", is_failed_login())
        if frequency:
            rows = windows.since_silence(rows, "attack_frequency", "timestamp", ttl)
        if recent:
            rows = windows.trailing(rows, "recent_events", F.coalesce("event", F.lit("unknown")), recent)
        return rows

    return by_heat(with_address(logs), KEY, LOG_ORDER, steps, hot, limit)


def detect(history: DataFrame, limit: int = fixed.FAILED_LOGIN_LIMIT) -> DataFrame:
    """Alert columns on rows with failed_login_count; anomaly_prediction and anomaly_score are used when present."""
    event = F.coalesce("event", F.lit("unknown"))
    if "anomaly_prediction" in history.columns:
        base = C.anomaly_severity(F.col("anomaly_prediction"), F.col("anomaly_score"))
        method, score = "isolation_forest", F.round("anomaly_score", 4)
    else:
        base, method, score = C.rule_severity(event), "rule_based", F.lit(None).cast("double")
    return history.withColumns(
        {
            "event": event,
            "severity": F.when(F.col("failed_login_count") > limit, "HIGH").otherwise(base),
            "detection_method": F.lit(method),
            "anomaly_score": score,
        }
    )


def flow_defaults(spark) -> DataFrame:
    """The fixed default features per event, one row each."""
    rows = [(event, [float(v) for v in values]) for event, values in fixed.EVENT_FLOW_DEFAULTS]
    return inline_table(spark, rows, "event string, defaults array<double>")


def flow_vectors(logs: DataFrame) -> DataFrame:
    """Add `features`: logged flow values, else the defaults of the event, else those of 'unknown'."""
    unknown = dict(fixed.EVENT_FLOW_DEFAULTS)["unknown"]
    joined = logs.join(F.broadcast(flow_defaults(logs.sparkSession)), "event", "left")
    defaults = F.coalesce("defaults", F.array(*[F.lit(float(v)) for v in unknown]))
    values = [F.coalesce(F.col(f"`{name}`"), defaults[i]) for i, name in enumerate(fixed.FLOW_FEATURES)]
    return joined.withColumn("features", F.array(*values)).drop("defaults")
