"""Session helpers: where durable intermediate tables live, and small in-plan tables."""

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_dirs: dict[str, str] = {}


def durable_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own: on a cluster an executor's disk dies with the executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    already = context.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="palisade-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{durable_dir(spark)}/palisade/{name}-{uuid.uuid4().hex}"


# For rows of megabytes: the writer looks at its size after every row, else a hundred of them would lie in memory, and
# readers hold few of them at a time.
LARGE_ROWS = {
    "parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
    "parquet.enable.dictionary": "false",
}


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df once and read it back: cuts the lineage, survives lost executors, stays columnar for later scans. Stored by
    zstd, as texts take less disk by it than by the default codec."""
    path = new_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: dict[tuple, str] = {}


def made_once(spark: SparkSession, key: tuple, write: Callable[[str], object]) -> str:
    """The path that write(path) filled, once per application and key; again where it has been cleared away since."""
    key = (spark.sparkContext.applicationId, *key)
    path = _made.get(key)
    if path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return path
    path = new_path(spark, str(key[-1]))
    write(path)
    _made[key] = path
    return path


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Write a lookup table once and count it; broadcast it only when the count is small, else leave the join to Spark."""
    stored = materialize(df, "lookup")
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def _literal(value, field: T.DataType) -> str:
    if value is None:
        text = "NULL"
    elif isinstance(field, T.ArrayType):
        text = "array(" + ", ".join(_literal(v, field.elementType) for v in value) + ")"
    elif isinstance(value, str):
        text = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    elif isinstance(value, float) and not math.isfinite(value):
        text = f"'{value}'"
    else:
        text = repr(value)
    return f"CAST({text} AS {field.simpleString()})"


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table inside the plan; for fixed values and for results whose row count has a known bound."""
    fields = T._parse_datatype_string(schema).fields
    if not 0 < len(rows) <= 1000:
        return spark.createDataFrame(rows, T.StructType(fields))
    body = ", ".join("(" + ", ".join(_literal(v, f.dataType) for v, f in zip(row, fields)) + ")" for row in rows)
    names = ", ".join(f"`{f.name}`" for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
