"""Flow preparation: cleaning, imputing, scaling, label codes, severity sets, splits and dataset facts."""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import fixed
from palisade.functions import columns as C
from palisade.operators.quantiles import exact_quantiles
from palisade.session import checked_broadcast, inline_table

TEST_SHARE = 0.2
SEED = 42


# --- columns ----------------------------------------------------------------------------------------------------------


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _replace(df: DataFrame, columns: list[str] | None, change) -> DataFrame:
    chosen = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: change(F.col(f"`{c}`")) for c in chosen})


def infinite_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _replace(df, columns, C.clean_to_null)


def infinite_to_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _replace(df, columns, C.infinite_to_zero)


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column missing in one frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [strip_names(f) for f in frames])


def drop_null_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.dropna(subset=[label])


# --- imputing and scaling ---------------------------------------------------------------------------------------------


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return exact_quantiles(df, columns, 0.5)


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Fill nulls with fitted values (one number per column); a column without any value stays null."""
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in values.items() if v is not None}
    return df.withColumns(filled) if filled else df


def scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population standard deviation)}, one pass; a constant column gets divisor 1."""
    row = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def max_norm(df: DataFrame, column: str, name: str) -> DataFrame:
    """value / (largest value + 1), the largest value being one number of its own small job."""
    top = df.agg(F.max(f"`{column}`")).first()[0]
    return df.withColumn(name, F.col(f"`{column}`") / F.lit(None if top is None else top + 1).cast("double"))


# --- labels -----------------------------------------------------------------------------------------------------------


def label_mapping(df: DataFrame, label: str = "Label") -> DataFrame:
    """Dense codes of the distinct labels in alphabetical order; the rows are combined to distinct labels first."""
    labels = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    code = F.row_number().over(Window.orderBy("label")) - 1
    return labels.withColumn("code", code.cast("int"))


def label_mapping_first(df: DataFrame, order: list[str], label: str = "Label") -> DataFrame:
    """Dense codes of the distinct labels in order of first appearance; a missing label is the class 'nan'."""
    name = F.coalesce(F.trim(label), F.lit("nan")).alias("label")
    first = df.groupBy(name).agg(F.min(F.struct(*order)).alias("first"))
    code = F.row_number().over(Window.orderBy("first")) - 1
    return first.select("label", code.cast("int").alias("code"))


def encode(df: DataFrame, mapping: DataFrame, label: str = "Label", name: str = "code") -> DataFrame:
    """Add the class code; the mapping has one row per class."""
    codes = checked_broadcast(mapping.select(F.col("label").alias(label), F.col("code").alias(name)))
    return df.join(codes, label, "left")


def decode(df: DataFrame, mapping: DataFrame, code: str = "code", name: str = "label", unknown: str | None = None) -> DataFrame:
    """Add the label of a class code; a code outside the mapping becomes `class_<code>`, or `unknown` when given."""
    missing = F.concat(F.lit("class_"), F.col(code).cast("string")) if unknown is None else F.lit(unknown)
    names = checked_broadcast(mapping.select(F.col("code").alias(code), F.col("label").alias("_label")))
    return df.join(names, code, "left").withColumn(name, F.coalesce("_label", missing)).drop("_label")


def one_hot(code: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == code).cast("int"))


def label_counts(df: DataFrame, label: str = "Label") -> DataFrame:
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label)


# --- severity set -----------------------------------------------------------------------------------------------------


def severity_dataset(flows: DataFrame) -> DataFrame:
    """Five features and a severity by label: infinities become 0, rows with a missing feature are dropped."""
    features = fixed.SEVERITY_SET_FEATURES
    labelled = flows.withColumn("severity", C.label_severity(F.trim("Label"), "basic"))
    return infinite_to_zero(labelled, features).dropna(subset=features)


def preprocess(flows: DataFrame, features: list[str] | None = None, keys: list[str] = ()) -> DataFrame:
    """Cleaned flows: infinities to null, null labels dropped, medians filled in, labels as codes.

    All numeric columns but `keys` are cleaned and filled when no features are named.
    """
    features = features or [c for c in numeric_columns(flows) if c not in keys]
    clean = drop_null_labels(infinite_to_null(flows, features))
    filled = impute(clean, medians(clean, features))
    return encode(filled, label_mapping(clean), name="label_code")


# --- splits -----------------------------------------------------------------------------------------------------------


def row_hash(key: list[str], seed: int = SEED) -> Column:
    """32 hex digits that depend on the row key and the seed only: the same split on every cluster."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))


def hash_split(df: DataFrame, key: list[str], test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add `part` = test/train by a threshold on the row hash; no shuffle."""
    edge = f"{int(test_share * 2**32):08x}"
    return df.withColumn("part", F.when(F.substring(row_hash(key, seed), 1, 8) < edge, "test").otherwise("train"))


def stratified_split(
    df: DataFrame,
    key: list[str],
    label: str = "Label",
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    digits: int | None = None,
) -> DataFrame:
    """Add `part`: of every label exactly ceil(share x rows) rows are test, those with the smallest row hash.

    Sorting a label that holds most rows in one task is avoided: a histogram over the first `digits` hex digits of the
    hash gives, per label, the digit group in which the count is reached; only the rows of that one group are ranked
    (1/16^digits of the label), and everything before or after it is decided by comparing digits. The number of rows
    sets the digits when they are not given.
    """
    digits = split_digits(df.count()) if digits is None else digits
    rows = df.filter(F.col(label).isNotNull()).withColumn("_hash", row_hash(key, seed))
    rows = rows.withColumn("_head", F.substring("_hash", 1, digits))
    groups = rows.groupBy(label, "_head").agg(F.count(F.lit(1)).alias("n"))
    per_label = Window.partitionBy(label)
    upto = per_label.orderBy("_head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        groups.withColumn("_want", F.ceil(F.sum("n").over(per_label) * F.lit(test_share)))
        .withColumn("_reached", F.sum("n").over(upto))
        .filter((F.col("_reached") >= F.col("_want")) & (F.col("_reached") - F.col("n") < F.col("_want")))
        .select(label, F.col("_head").alias("_cut"), (F.col("_want") - F.col("_reached") + F.col("n")).alias("_left"))
    )
    marked = rows.join(checked_broadcast(cuts), label)
    inside = marked.filter(F.col("_head") == F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_hash", *key))
    ranked = inside.withColumn("part", F.when(rank <= F.col("_left"), "test").otherwise("train"))
    decided = marked.filter(F.col("_head") != F.col("_cut")).withColumn(
        "part", F.when(F.col("_head") < F.col("_cut"), "test").otherwise("train")
    )
    return decided.unionByName(ranked).drop("_hash", "_head", "_cut", "_left")


def split_digits(rows: int, per_group: int = 100_000) -> int:
    """Hex digits that keep a digit group of a label with `rows` rows near `per_group` rows."""
    return max(2, math.ceil(math.log(max(rows / per_group, 1), 16)))


# --- facts about a dataset --------------------------------------------------------------------------------------------


def split_counts(parts: DataFrame, label: str = "Label") -> DataFrame:
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(label).cast("bigint").alias("classes")
    )


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, mean, population deviation, maximum and exact median per column, one row per column."""
    row = df.agg(
        *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.max(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)],
    ).first()
    middle = medians(df, columns)
    rows = [
        (c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"x{i}"], middle[c]) for i, c in enumerate(columns)
    ]
    return inline_table(
        df.sparkSession, rows, "feature string, n bigint, mean double, std double, top double, median double"
    )
