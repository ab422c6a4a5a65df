"""Row shapes of the log, alert and flow tables."""

from pyspark.sql import types as T

from palisade.fixed import FLOW_FEATURES

LOG = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("user", T.StringType()),
        # kept as text on the wire: a non-numeric timestamp is data to handle, not a reason to lose the row
        T.StructField("timestamp", T.StringType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in FLOW_FEATURES]
)

ACTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("action", "target", "command", "event", "status", "note")]
)

# The stored alert table; the columns from `ip` to `agent_source` joined it after its first version.
STORED_ALERT = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("investigation", T.StringType()),
        T.StructField("mitre_attack", T.StringType()),
        T.StructField("predicted_next_attack", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("agent_source", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

FLOW = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in FLOW_FEATURES] + [T.StructField("Label", T.StringType())]
)
