"""Per-address history on a stream: one state, one exchange for all three history columns."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palisade import fixed
from palisade.operators.detect import KEY, with_address

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = T.StructType(
    [
        T.StructField("failed", T.LongType()),
        T.StructField("frequency", T.LongType()),
        T.StructField("last_seen", T.DoubleType()),
        T.StructField("recent", T.ArrayType(T.StringType())),
    ]
)
_ADDED = [
    T.StructField("failed_login_count", T.LongType()),
    T.StructField("attack_frequency", T.LongType()),
    T.StructField("recent_events", T.ArrayType(T.StringType())),
]


class AddressHistory(StatefulProcessor):
    """Failed logins so far, events since the last silence and the last events of an address.

    The rows of an address in one micro-batch are put in event order first; their number is bounded by what the source
    admits per trigger. Across micro-batches the order is that of arrival.
    """

    def __init__(self, columns: list[str], recent: int, silence: float, ttl_ms: int | None):
        self.columns, self.recent, self.silence, self.ttl_ms = columns, recent, silence, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch.columns = self.columns  # names that are no Python identifiers arrive as positions
        # rows without a time come first, as in the batch windows
        batch = batch.sort_values(["timestamp", "log_id"], na_position="first", ignore_index=True)
        failed, frequency, last_seen, recent = self.state.get() if self.state.exists() else (0, 0, None, [])
        events = batch["event"].fillna("unknown").tolist()

        counted = (batch["event"] == fixed.FAILED_LOGIN) & batch["ip"].notna() & (batch["ip"] != "")
        totals = failed + counted.cumsum().to_numpy()
        batch["failed_login_count"] = pd.array(totals, dtype="Int64")
        batch.loc[~counted, "failed_login_count"] = pd.NA

        since = np.ones(len(batch), np.int64)  # a row without a time stands alone and does not end a run of others
        dated = batch["timestamp"].notna().to_numpy()
        if dated.any():
            seen = batch["timestamp"].to_numpy(dtype=float)[dated]
            before = np.concatenate([[np.nan if last_seen is None else last_seen], seen[:-1]])
            place = np.arange(len(seen))
            fresh = np.isnan(before) | (seen - before > self.silence)
            start = np.maximum.accumulate(np.where(fresh, place, -1))
            since[dated] = np.where(start < 0, frequency + place + 1, place - start + 1)
            frequency = int(since[dated][-1])
            last_seen = float(seen[-1] if last_seen is None else max(last_seen, seen[-1]))
        batch["attack_frequency"] = since

        history = list(recent or []) + events
        had = len(history) - len(events)
        batch["recent_events"] = [
            history[max(0, had + i + 1 - self.recent) : had + i + 1] for i in range(len(events))
        ]
        self.state.update((int(totals[-1]), frequency, last_seen, history[-self.recent :]))
        yield batch

    def close(self) -> None:
        pass


def stream_history(
    logs: DataFrame,
    recent: int = fixed.SEQUENCE_LENGTH,
    silence: float = fixed.FREQUENCY_TTL_SECONDS,
    ttl_ms: int | None = None,
) -> DataFrame:
    """failed_login_count, attack_frequency and recent_events on a stream of logs.

    `ttl_ms` forgets addresses that stay idle so long. It is for queries that keep running: with it Spark plans one more
    batch as long as state could expire, so an availableNow run would not end.
    """
    rows = with_address(logs)
    schema = T.StructType([*rows.schema.fields, *_ADDED])
    mode = "ProcessingTime" if ttl_ms else "None"
    processor = AddressHistory(rows.columns, recent, silence, ttl_ms)
    return rows.groupBy(KEY).transformWithStateInPandas(processor, schema, "Append", mode)


def prepare_session(spark) -> None:
    """Settings the stateful queries need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
