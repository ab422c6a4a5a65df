"""Batch sources and sinks: flow CSVs, JSON records, alert table, logs, reports, mappings, schema evolution."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import fixed
from palisade.functions import columns as C
from palisade.operators import prep
from palisade.schemas import LOG, STORED_ALERT

CORRUPT = "_corrupt"
# where a record stands in its source; names records that come without an id
RECORD_KEY = "record_key"
UNDATED = "0001-01-01"
# what an alert does not have yet when it is stored on detection
LATER = ("investigation", "mitre_attack", "predicted_next_attack", "confidence")


# --- flow CSV ---------------------------------------------------------------------------------------------------------


def _typed_flows(raw: DataFrame) -> DataFrame:
    """Text columns of a flow CSV: names stripped, everything but the label a double, NaN as null."""
    raw = raw.withColumn("file_name", F.col("_metadata.file_name"))
    named = prep.strip_names(raw)
    columns = []
    for name in named.columns:
        c = F.col(f"`{name}`")
        if name in ("Label", "file_name"):
            columns.append(c.alias(name))
        else:
            number = c.try_cast("double")
            columns.append(F.when(~F.isnan(number), number).alias(name))
    return named.select(*columns)


def csv_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, names: the header of every CSV file, read by the executors in one job however many files there are.

    A part of a file that does not begin it, or that is one of several, is left after its first batch of lines.
    """
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length", "file_size")]
    lines = spark.read.text(paths).select("value", *meta)

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            found = []
            path = batch.column(1).dictionary_encode()
            at = {code: i for i, code in reversed(list(enumerate(path.indices.to_pylist())))}
            for code, i in at.items():
                name = path.dictionary[code].as_py()
                if name not in seen and batch.column(2)[i].as_py() == 0:
                    found.append((name, column_names(batch.column(0)[i].as_py())))
                seen.add(name)
            names, headers = zip(*found) if found else ((), ())
            yield pa.record_batch({"path": pa.array(names, pa.string()), "names": pa.array(headers, pa.list_(pa.string()))})
            start, length, size = (batch.column(c)[0].as_py() for c in (2, 3, 4)) if batch.num_rows else (0, 1, 1)
            if length < size and start % length == 0:
                return  # a whole part of a larger file fills a task alone

    return lines.mapInArrow(first_lines, "path string, names array<string>")


def column_names(line: str) -> list[str]:
    """Column names of a header line; empty ones and repeated ones get their position, as the reader would give them."""
    names = next(csv.reader([line.lstrip("\ufeff")]), [])
    often = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if often[n.lower()] > 1 else n for i, n in enumerate(names)]


def read_flow_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Flow CSVs with a header each, one glob or a list of paths, stacked by column name.

    Files are read by their own headers, those with one header together. A glob without a match raises when the path is
    resolved. No schema inference pass is made.
    """
    alike = csv_headers(spark, paths).groupBy("names").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    read = []
    for row in alike.orderBy("names").collect():  # names of files only
        schema = T.StructType([T.StructField(name, T.StringType()) for name in row["names"]])
        # what stands for itself in a file's name must not be read as a pattern
        files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path)) for path in row["paths"]]
        read.append(_typed_flows(spark.read.schema(schema).option("header", True).csv(files)))
    if not read:
        raise ValueError(f"no file with a header in {paths}")
    return prep.union_files(read)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


# --- JSON records -----------------------------------------------------------------------------------------------------


def decode_logs(records: DataFrame, column: str = "value", given: str | None = None) -> DataFrame:
    """Log columns of JSON text, with the text itself in `_corrupt` when it does not parse. Batch or stream.

    Missing keys and JSON nulls both become null; `timestamp` is numeric epoch seconds or null. A record without
    `log_id` gets a negative one made of its place in the source (`record_key`), or of its text where there is none; a
    column `given`, when named, says which records came with an id.
    """
    schema = T.StructType([*LOG.fields, T.StructField(CORRUPT, T.StringType())])
    text = F.col(column).cast("string")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kept = [c for c in records.columns if c not in (column, RECORD_KEY)]
    place = F.coalesce(F.col(RECORD_KEY), text) if RECORD_KEY in records.columns else text
    rows = records.select(*kept, text.alias("_text"), place.alias("_place"), parsed.alias("_log"))
    rows = rows.select(*kept, "_text", "_place", "_log.*")
    if given:
        rows = rows.withColumn(given, F.col("log_id").isNotNull())
    derived = F.lit(-1) - F.xxhash64("_place").bitwiseAND(F.lit(2**63 - 1))
    number = F.col("timestamp").try_cast("double")
    return (
        rows.withColumn(CORRUPT, F.when(F.col(CORRUPT).isNotNull() | F.col("_text").isNull(), F.coalesce("_text", F.lit(""))))
        .withColumn("timestamp", F.when(~F.isnan(number), number))
        .withColumn("log_id", F.coalesce("log_id", F.when(F.col(CORRUPT).isNull(), derived)))
        .drop("_text", "_place")
    )


def encode_json(df: DataFrame, name: str = "value") -> DataFrame:
    """Rows as JSON text; columns that JSON has no type for are written as text, nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def failure_cause(rows: DataFrame) -> Column:
    """Why a decoded row cannot be processed; null when it can."""
    return F.when(F.col(CORRUPT).isNotNull(), "malformed")


def split_dead_letters(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to process, failed rows with their cause). Both read the same columns, so both stay one scan with a filter."""
    marked = decoded.withColumn("cause", failure_cause(decoded))
    good = marked.filter("cause IS NULL").drop("cause", CORRUPT)
    return good, marked.filter("cause IS NOT NULL").select("cause", "log_id", F.col(CORRUPT).alias("record"))


# --- alert table ------------------------------------------------------------------------------------------------------


def stored_form(alerts: DataFrame, stage: str, *more: Column) -> DataFrame:
    """Alert rows as the table keeps them: defaults applied, confidence as text or null when it says nothing."""
    have = set(alerts.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    confidence = column("confidence").cast("double")
    return alerts.select(
        "log_id",
        F.lit(stage).alias("stage"),
        F.coalesce(column("event"), F.lit("unknown")).alias("event"),
        F.coalesce(column("severity"), F.lit("LOW")).alias("severity"),
        *[
            column(c).cast("string").alias(c)
            for c in ("ip", "user", "investigation", "mitre_attack", "predicted_next_attack")
        ],
        F.when(confidence.isNotNull() & (confidence != 0), confidence.cast("string")).alias("confidence"),
        column("agent_source").cast("string").alias("agent_source"),
        C.alert_time(column("timestamp")).alias("timestamp"),
        *more,
    )


def append_alerts(alerts: DataFrame, path: str, stage: str) -> None:
    """Append the alerts that are not yet in the table, by log_id and stage.

    The table is partitioned by stage and day, so a repeated batch is compared with its own days only. The day is the
    record's own, never the clock's: records without a timestamp share one. The append itself is one job whose files
    appear on commit. Stage `detected` leaves out what later stages add.
    """
    spark = alerts.sparkSession
    alerts = alerts.drop(*LATER) if stage == "detected" else alerts
    own = F.col("_seconds").cast("string").try_cast("double") if "timestamp" in alerts.columns else F.lit(None)
    dated = alerts.withColumn("_seconds", F.col("timestamp")) if "timestamp" in alerts.columns else alerts
    day = F.when(own.isNotNull(), F.to_date(C.alert_time(own))).otherwise(F.lit(UNDATED).cast("date"))
    new = stored_form(dated, stage, day.alias("day")).dropDuplicates(["log_id", "stage"])
    try:
        stored = spark.read.schema(_with_day()).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = None
    if stored is not None:
        known = stored.filter(F.col("stage") == stage).join(new.select("day").distinct(), "day", "left_semi")
        new = new.join(known.select("log_id", "stage"), ["log_id", "stage"], "left_anti")
    # few, evenly sized files per day: the hint merges small days and splits large ones
    new.hint("rebalance", "day").write.mode("append").partitionBy("stage", "day").parquet(path)


def _with_day() -> T.StructType:
    return T.StructType([*STORED_ALERT.fields, T.StructField("day", T.DateType())])


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alert table; files written before a column existed give null for it."""
    return spark.read.schema(_with_day()).parquet(path).select(*STORED_ALERT.names)


def add_missing_columns(df: DataFrame, schema: T.StructType = STORED_ALERT) -> DataFrame:
    """Older rows under the current schema: missing columns are added as null, others are kept."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


# --- logs, reports, summary, mappings ---------------------------------------------------------------------------------


def append_action_log(log: DataFrame, path: str) -> None:
    rows = log.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day")
    rows.write.mode("append").partitionBy("day").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Incident reports as JSON records, a folder per severity rather than a file per incident."""
    reports.write.mode("overwrite").partitionBy("severity").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Replace the summary snapshot; its rows are totals, severities, tactics and addresses."""
    summary.withColumn("last_updated", F.current_timestamp()).write.mode("overwrite").parquet(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """A label -> code table as JSON records; one row per class, hence one file."""
    mapping.coalesce(1).write.mode("overwrite").json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, code int").json(path)


def severity_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.SEVERITY_CODES.items()), "label string, code int")


def write_sequences(sequences: DataFrame, facts: DataFrame | Callable[[DataFrame], DataFrame], path: str) -> None:
    """Training windows as a table, with the facts a training run has to agree with beside it. Facts given as a function
    are taken of the written table, so the windows are made and stored once."""
    sequences.write.mode("overwrite").parquet(f"{path}/windows")
    if callable(facts):
        facts = facts(sequences.sparkSession.read.schema(sequences.schema).parquet(f"{path}/windows"))
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    facts = spark.read.json(f"{path}/metadata").first().asDict()
    return spark.read.parquet(f"{path}/windows"), facts


# --- database ---------------------------------------------------------------------------------------------------------


def read_alerts_jdbc(spark: SparkSession, url: str, table: str, ids: tuple[int, int], parts: int, **options) -> DataFrame:
    """Alert table of a database, read in `parts` id ranges; needs the database's driver on the class path."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="log_id", lowerBound=ids[0], upperBound=ids[1], numPartitions=parts
    )
    return reader.options(**options).load()


def append_alerts_jdbc(stored: DataFrame, url: str, table: str, **options) -> None:
    stored.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
