"""Response: tiered actions per alert, the action log and incident reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed
from palisade.functions import columns as C
from palisade.schemas import ACTION


def _action(name: str, target: Column, event: Column | None = None, note: Column | None = None) -> Column:
    command, status, text = fixed.RESPONSES[name]
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(name).alias("action"),
        target.alias("target"),
        (F.format_string(command, target) if command else nothing).alias("command"),
        (nothing if event is None else event).alias("event"),
        F.lit(status).alias("status"),
        (F.lit(text) if note is None else note).alias("note"),
    )


def actions(severity: Column, event: Column, ip: Column, user: Column) -> Column:
    """Array of action structs of the severity tier; commands are text for an operator, nothing is run."""
    ip, user, event = C.or_unknown(ip), C.or_unknown(user), F.coalesce(event, F.lit("unknown"))
    known_user = user != "unknown"
    escalation = F.format_string(fixed.RESPONSES["ESCALATE_TO_ANALYST"][2], event)
    tiers = (
        F.when(
            severity == "CRITICAL",
            F.array_compact(
                F.array(
                    _action("BLOCK_IP", ip),
                    F.when(known_user, _action("ISOLATE_USER", user)),
                    _action("ESCALATE_TO_ANALYST", ip, note=escalation),
                )
            ),
        )
        .when(
            severity == "HIGH",
            F.array_compact(F.array(_action("BLOCK_IP", ip), F.when(known_user, _action("FLAG_USER_FOR_REVIEW", user)))),
        )
        .when(severity == "MEDIUM", F.array(_action("RATE_LIMIT_IP", ip), _action("INCREASE_MONITORING", ip)))
        .otherwise(F.array(_action("AUDIT_LOG", ip, event=event)))
    )
    return tiers.cast(f"array<{ACTION.simpleString()}>")


def respond(alerts: DataFrame, now: Column | None = None) -> DataFrame:
    return alerts.withColumns(
        {
            "remediation_actions": actions(F.col("severity"), F.col("event"), F.col("ip"), F.col("user")),
            "remediated_at": F.current_timestamp() if now is None else now,
        }
    ).withColumn("remediation_count", F.size("remediation_actions"))


def exploded_actions(remediated: DataFrame) -> DataFrame:
    """One row per action of an alert, numbered from 0."""
    return remediated.select("log_id", "severity", F.posexplode("remediation_actions").alias("action_no", "a")).select(
        "log_id", "severity", "action_no", "a.*"
    )


def action_log(remediated: DataFrame) -> DataFrame:
    return remediated.select(
        F.col("remediated_at").alias("timestamp"),
        "event",
        "severity",
        "ip",
        "user",
        F.col("remediation_actions").alias("actions"),
        F.col("mitre_attack").alias("mitre"),
    )


def reports(remediated: DataFrame, now: Column | None = None) -> DataFrame:
    """One incident report per remediated alert; the id is a function of log_id, so a rerun gives the same reports."""
    now = F.current_timestamp() if now is None else now

    def column(name: str, default=None, kind: str = "string") -> Column:
        found = F.col(name) if name in remediated.columns else F.lit(None).cast(kind)
        return (found if default is None else F.coalesce(found, F.lit(default))).alias(name)

    return remediated.select(
        C.incident_id(F.col("log_id")).alias("incident_id"),
        now.alias("generated_at"),
        column("event", "unknown"),
        column("severity", "LOW"),
        column("ip"),
        column("user"),
        F.coalesce(F.col("timestamp").cast("double"), now.cast("double")).alias("timestamp"),
        column("detection_method", "unknown"),
        column("anomaly_score", kind="double"),
        column("investigation"),
        column("investigation_method"),
        column("predicted_next_attack"),
        column("confidence", kind="double").alias("lstm_confidence"),
        column("mitre_attack"),
        column("mitre_tactic"),
        column("mitre_confidence", kind="double"),
        column("recommended_action"),
        F.coalesce("remediation_actions", F.array().cast(f"array<{ACTION.simpleString()}>")).alias("remediation_actions"),
        F.coalesce("remediation_count", F.lit(0)).alias("remediation_count"),
        "remediated_at",
    )
