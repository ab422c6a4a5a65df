"""Queries over the network flows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed
from palisade.functions import columns as C
from palisade.operators import metrics, prep, sequences
from palisade.plans.registry import query
from palisade.plans.sql import BASIC, KEY, RICH, SHOWN_KEY, flows, near, windows
from palisade.sources.adapters import FLOW_KEY, network_flows

FEATURES = fixed.FLOW_FEATURES
# Feature columns under short names, rounded for comparison.
SHORT = [f"f{i + 1}" for i in range(len(FEATURES))]


def shown_key() -> list:
    return [F.col("l_shipdate").cast("date").cast("string").alias("ship_day"), *FLOW_KEY[1:]]


def _sql_features() -> str:
    return ", ".join(f'"{c}" AS {s}' for c, s in zip(FEATURES, SHORT))


def rounded_features(digits: int | None = None) -> list:
    if digits is None:
        return [F.col(f"`{c}`").alias(s) for c, s in zip(FEATURES, SHORT)]
    return [(F.floor(F.col(f"`{c}`") * 10**digits + 0.5) / 10**digits).alias(s) for c, s in zip(FEATURES, SHORT)]


def _stat(template: str) -> str:
    return ", ".join(template.format(c=f'"{c}"', s=s) for c, s in zip(FEATURES, SHORT))


@query("clean_inf_null", flows(f"SELECT {SHOWN_KEY}, {_sql_features()} FROM nulled"))
def clean_inf_null(spark, sf_dir) -> DataFrame:
    return prep.infinite_to_null(network_flows(spark, sf_dir), FEATURES).select(*shown_key(), *rounded_features())


@query("clean_inf_zero", flows(f"SELECT {SHOWN_KEY}, {_sql_features()} FROM zeroed"))
def clean_inf_zero(spark, sf_dir) -> DataFrame:
    return prep.infinite_to_zero(network_flows(spark, sf_dir), FEATURES).select(*shown_key(), *rounded_features())


@query("severity_basic", flows(f'SELECT {SHOWN_KEY}, {BASIC} AS severity FROM flows'))
def severity_basic(spark, sf_dir) -> DataFrame:
    severity = C.label_severity(F.trim("Label"), "basic").alias("severity")
    return network_flows(spark, sf_dir).select(*shown_key(), severity)


@query("severity_rich", flows(f'SELECT {SHOWN_KEY}, {RICH} AS severity FROM flows WHERE "Label" IS NOT NULL'))
def severity_rich(spark, sf_dir) -> DataFrame:
    rows = prep.drop_null_labels(network_flows(spark, sf_dir))
    return rows.select(*shown_key(), C.label_severity(F.trim("Label"), "rich").alias("severity"))


@query(
    "severity_encode",
    flows(f"""SELECT s AS severity, CASE s WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS code,
              count(*) AS n FROM (SELECT {RICH} AS s FROM flows) t GROUP BY ALL"""),
)
def severity_encode(spark, sf_dir) -> DataFrame:
    rows = network_flows(spark, sf_dir).select(C.label_severity(F.trim("Label"), "rich").alias("severity"))
    return rows.groupBy("severity", C.severity_code(F.col("severity"), None).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "severity_dataset",
    flows(f"""SELECT {SHOWN_KEY}, "Flow Duration" AS f1, "Total Fwd Packets" AS f2, "Total Backward Packets" AS f3,
              "Flow Bytes/s" AS f4, "Flow Packets/s" AS f5, {BASIC} AS severity FROM zeroed
              WHERE "Flow Bytes/s" IS NOT NULL AND "Flow Packets/s" IS NOT NULL"""),
)
def severity_dataset(spark, sf_dir) -> DataFrame:
    rows = prep.severity_dataset(network_flows(spark, sf_dir))
    return rows.select(*shown_key(), *rounded_features()[:5], "severity")


@query(
    "median_impute",
    flows(f"""SELECT {SHOWN_KEY}, {_stat(near("coalesce({c}, m_{s})", 4) + " AS {s}")} FROM labelled,
              (SELECT {_stat("quantile_cont({c}, 0.5) AS m_{s}")} FROM labelled) m"""),
)
def median_impute(spark, sf_dir) -> DataFrame:
    rows = prep.drop_null_labels(prep.infinite_to_null(network_flows(spark, sf_dir), FEATURES))
    return prep.impute(rows, prep.medians(rows, FEATURES)).select(*shown_key(), *rounded_features(4))


@query(
    "standard_scale",
    flows(f"""SELECT {SHOWN_KEY}, {_stat("round(({c}-a_{s})/CASE WHEN d_{s}=0 THEN 1 ELSE d_{s} END, 4)+0.0 AS {s}")}
              FROM labelled, (SELECT {_stat("avg({c}) AS a_{s}, stddev_pop({c}) AS d_{s}")} FROM labelled) m"""),
)
def standard_scale(spark, sf_dir) -> DataFrame:
    rows = prep.drop_null_labels(prep.infinite_to_null(network_flows(spark, sf_dir), FEATURES))
    scaled = prep.scale(rows, prep.scaler(rows, FEATURES))
    return scaled.select(*shown_key(), *[(F.round(F.col(f"`{c}`"), 4) + 0.0).alias(s) for c, s in zip(FEATURES, SHORT)])


@query(
    "feature_stats",
    flows(" UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count("{c}") AS n, round(avg("{c}"),4) AS mean, round(stddev_pop("{c}"),4) AS std,
            max("{c}") AS top, round(quantile_cont("{c}",0.5),6) AS median FROM nulled""" for c in FEATURES)),
)
def feature_stats(spark, sf_dir) -> DataFrame:
    stats = prep.feature_stats(prep.infinite_to_null(network_flows(spark, sf_dir), FEATURES), FEATURES)
    return stats.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "median": F.round("median", 6)})


@query(
    "score_quantile",
    flows("""SELECT round(quantile_cont("Flow Packets/s", 0.02),6) AS packets, round(quantile_cont("Flow Bytes/s", 0.02),6) AS bytes
             FROM labelled"""),
)
def score_quantile(spark, sf_dir) -> DataFrame:
    from palisade.operators.quantiles import exact_quantiles
    from palisade.session import inline_table

    rows = prep.drop_null_labels(prep.infinite_to_null(network_flows(spark, sf_dir), FEATURES))
    found = exact_quantiles(rows, ["Flow Packets/s", "Flow Bytes/s"], 0.02)
    return inline_table(spark, [tuple(round(v, 6) for v in found.values())], "packets double, bytes double")


@query("max_norm", flows(f"""SELECT {SHOWN_KEY}, round("Flow Packets/s"/((SELECT max("Flow Packets/s") FROM zeroed)+1),8) AS score FROM zeroed"""))
def max_norm(spark, sf_dir) -> DataFrame:
    rows = prep.infinite_to_zero(network_flows(spark, sf_dir), ["Flow Packets/s"])
    return prep.max_norm(rows, "Flow Packets/s", "score").select(*shown_key(), F.round("score", 8).alias("score"))


# --- labels and files -------------------------------------------------------------------------------------------------


@query("label_mapping", flows('SELECT class AS label, code FROM mapping'))
def label_mapping(spark, sf_dir) -> DataFrame:
    return prep.label_mapping(network_flows(spark, sf_dir))


@query(
    "label_mapping_first",
    flows(f"""SELECT lab AS label, CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber)-1 AS INT) AS code
              FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY {KEY}) AS rn
               FROM (SELECT *, coalesce(trim("Label"),'nan') AS lab FROM flows) a) t WHERE rn=1"""),
)
def label_mapping_first(spark, sf_dir) -> DataFrame:
    return prep.label_mapping_first(network_flows(spark, sf_dir), FLOW_KEY)


@query("label_encode", flows(f'SELECT {SHOWN_KEY}, "Label" AS label, code FROM labelled JOIN mapping ON class="Label"'))
def label_encode(spark, sf_dir) -> DataFrame:
    rows = prep.drop_null_labels(network_flows(spark, sf_dir))
    coded = prep.encode(rows, prep.label_mapping(rows))
    return coded.select(*shown_key(), F.col("Label").alias("label"), "code")


@query("one_hot", flows(f"""SELECT {SHOWN_KEY}, code, repeat('0',code)||'1'||repeat('0',(SELECT count(*)::INT FROM mapping)-1-code) AS hot
                            FROM labelled JOIN mapping ON class="Label" """))  # fmt: skip
def one_hot(spark, sf_dir) -> DataFrame:
    rows = prep.drop_null_labels(network_flows(spark, sf_dir))
    mapping = prep.label_mapping(rows)
    classes = mapping.count()
    coded = prep.encode(rows, mapping)
    hot = F.array_join(F.transform(prep.one_hot(F.col("code"), classes), lambda x: x.cast("string")), "")
    return coded.select(*shown_key(), "code", hot.alias("hot"))


@query("label_counts", flows('SELECT "Label" AS label, count(*) AS n FROM flows WHERE "Label" IS NOT NULL GROUP BY ALL'))
def label_counts(spark, sf_dir) -> DataFrame:
    return prep.label_counts(network_flows(spark, sf_dir)).withColumnRenamed("Label", "label")


@query(
    "flows_union",
    flows(f"""SELECT {SHOWN_KEY}, CASE WHEN file_id=0 THEN 0 ELSE 1 END AS source,
              CASE WHEN file_id=0 THEN NULL ELSE "Average Packet Size" END AS size, "Label" AS label FROM flows"""),
)
def flows_union(spark, sf_dir) -> DataFrame:
    """One file lacks a column and carries blanks around its names; the union is by name."""
    rows = network_flows(spark, sf_dir).select(*FLOW_KEY, "file_id", "Average Packet Size", "Label")
    first = rows.filter("file_id = 0").drop("Average Packet Size").withColumnRenamed("Label", " Label ")
    stacked = prep.union_files([rows.filter("file_id <> 0"), first])
    return stacked.select(
        *shown_key(),
        (F.col("file_id") != 0).cast("int").alias("source"),
        F.col("Average Packet Size").alias("size"),
        F.col("Label").alias("label"),
    )


# --- splits -----------------------------------------------------------------------------------------------------------


@query("stratified_split", flows(f'SELECT {SHOWN_KEY}, "Label" AS label, part FROM splits'))
def stratified_split(spark, sf_dir) -> DataFrame:
    parts = prep.stratified_split(network_flows(spark, sf_dir), FLOW_KEY)
    return parts.select(*shown_key(), F.col("Label").alias("label"), "part")


@query("hash_split", flows(f"SELECT {SHOWN_KEY}, CASE WHEN substr(row_hash,1,8)<'33333333' THEN 'test' ELSE 'train' END AS part FROM flows"))
def hash_split(spark, sf_dir) -> DataFrame:
    return prep.hash_split(network_flows(spark, sf_dir), FLOW_KEY).select(*shown_key(), "part")


@query("split_counts", flows('SELECT part, count(*) AS rows, count(DISTINCT "Label") AS classes FROM splits GROUP BY part'))
def split_counts(spark, sf_dir) -> DataFrame:
    return prep.split_counts(prep.stratified_split(network_flows(spark, sf_dir), FLOW_KEY))


# --- sequences --------------------------------------------------------------------------------------------------------


@query("label_cumcount", flows(f"""SELECT {SHOWN_KEY}, "Label" AS label, attack_frequency, CASE WHEN attack_frequency>3 THEN 1 ELSE 0 END AS repeated_ip FROM encoded"""))
def label_cumcount(spark, sf_dir) -> DataFrame:
    rows = network_flows(spark, sf_dir).dropna(subset=["Label", "Flow Packets/s", "Flow Bytes/s"])
    rows = sequences.cumulative_per_label(rows.select(*FLOW_KEY, F.trim("Label").alias("Label")))
    repeated = (F.col("attack_frequency") > fixed.OFFENDER_ABOVE).cast("int").alias("repeated_ip")
    return rows.select(*shown_key(), F.col("Label").alias("label"), "attack_frequency", repeated)


def window_text(seq) -> F.Column:
    """md5 of the windows' numbers as whole parts of the units used in the SQL."""
    scale = {"anomaly_score": 1_000_000, "packet_rate": 100}
    units = F.array(*[F.lit(scale.get(c, 1)) for c in fixed.SEQUENCE_FEATURES])

    def row(v):
        whole = F.zip_with(v, units, lambda x, u: F.floor(x * u + 0.5).cast("bigint").cast("string"))
        return F.array_join(whole, ",")

    return F.md5(F.array_join(F.transform(seq, row), ";"))


@query("sequence_dataset", flows(windows("PARTITION BY file_id")))
def sequence_dataset(spark, sf_dir) -> DataFrame:
    made, _ = sequences.dataset(network_flows(spark, sf_dir))
    return made.select(*shown_key(), "y", window_text(F.col("seq")).alias("seq_md5"))


@query("sequence_dataset_global", flows(windows("")))
def sequence_dataset_global(spark, sf_dir) -> DataFrame:
    made, _ = sequences.dataset(network_flows(spark, sf_dir), scope="global")
    return made.select(*shown_key(), "y", window_text(F.col("seq")).alias("seq_md5"))


@query("sequence_dataset_sliced", flows(windows("PARTITION BY file_id")))
def sequence_dataset_sliced(spark, sf_dir) -> DataFrame:
    """The windows per file with every label and every file treated as hot."""
    made, _ = sequences.dataset(network_flows(spark, sf_dir), limit=0)
    return made.select(*shown_key(), "y", window_text(F.col("seq")).alias("seq_md5"))


@query(
    "label_sequence_dataset",
    flows(f"""SELECT {SHOWN_KEY}, concat_ws(',', p5, p4, p3, p2, p1) AS seq, y FROM (
              SELECT f.*, m.code AS y, lag(m.code,1) OVER w AS p1, lag(m.code,2) OVER w AS p2, lag(m.code,3) OVER w AS p3,
               lag(m.code,4) OVER w AS p4, lag(m.code,5) OVER w AS p5
              FROM (SELECT *, coalesce(trim("Label"),'nan') AS lab FROM flows) f JOIN (
               SELECT lab, CAST(row_number() OVER (ORDER BY {KEY})-1 AS INT) AS code
               FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY {KEY}) AS nth
                FROM (SELECT *, coalesce(trim("Label"),'nan') AS lab FROM flows) a) b WHERE nth=1) m ON m.lab=f.lab
              WINDOW w AS (ORDER BY {KEY})) t WHERE p5 IS NOT NULL"""),
)
def label_sequence_dataset(spark, sf_dir) -> DataFrame:
    made = sequences.label_windows(network_flows(spark, sf_dir))
    return made.select(*shown_key(), F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"), "y")


@query(
    "sequence_metadata",
    flows(f"""SELECT 5 AS sequence_length, 6 AS num_features,
              CAST(greatest((SELECT count(*) FROM seq_codes), max(y)+1) AS INT) AS num_classes, count(*) AS dataset_size
              FROM ({windows("PARTITION BY file_id")}) w"""),
)
def sequence_metadata(spark, sf_dir) -> DataFrame:
    return sequences.metadata(*sequences.dataset(network_flows(spark, sf_dir)))


# --- evaluation -------------------------------------------------------------------------------------------------------

# A fixed prediction to evaluate: the `basic` severity against the `rich` one, and a rate threshold against the label.
_PAIRS = f'(SELECT {RICH} AS actual, {BASIC} AS predicted FROM flows WHERE "Label" IS NOT NULL) p'
_BINARY = """(SELECT CASE WHEN trim("Label")<>'BENIGN' THEN 1 ELSE 0 END AS actual,
  CASE WHEN "Flow Packets/s">1000 THEN 1 ELSE 0 END AS predicted FROM flows WHERE "Label" IS NOT NULL) p"""


def _severity_pairs(spark, sf_dir) -> DataFrame:
    rows = prep.drop_null_labels(network_flows(spark, sf_dir))
    label = F.trim("Label")
    return rows.select(
        C.label_severity(label, "rich").alias("actual"), C.label_severity(label, "basic").alias("predicted")
    )


@query("confusion_matrix", flows(f"SELECT actual, predicted, count(*) AS n FROM {_PAIRS} GROUP BY ALL"))
def confusion_matrix(spark, sf_dir) -> DataFrame:
    return metrics.confusion_matrix(_severity_pairs(spark, sf_dir), "actual", "predicted")


@query(
    "confusion_grid",
    flows("SELECT actual, " + ", ".join(f"count(*) FILTER (WHERE predicted='{s}') AS \"{s}\"" for s in fixed.SEVERITY_CODES)
          + f" FROM {_PAIRS} GROUP BY actual"),
)
def confusion_grid(spark, sf_dir) -> DataFrame:
    matrix = metrics.confusion_matrix(_severity_pairs(spark, sf_dir), "actual", "predicted")
    return metrics.confusion_grid(matrix, list(fixed.SEVERITY_CODES))


@query(
    "binary_metrics",
    flows(f"""SELECT tp, fp, fn, tn, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy, round(coalesce(tp/nullif(tp+fp,0),0),6) AS precision,
              round(coalesce(tp/nullif(tp+fn,0),0),6) AS recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1,
              round(coalesce(fp/nullif(fp+tn,0),0),6) AS false_positive_rate, round(coalesce(tp/nullif(tp+fn,0),0),6) AS detection_rate
              FROM (SELECT count(*) FILTER (WHERE actual=1 AND predicted=1) AS tp, count(*) FILTER (WHERE actual=0 AND predicted=1) AS fp,
               count(*) FILTER (WHERE actual=1 AND predicted=0) AS fn, count(*) FILTER (WHERE actual=0 AND predicted=0) AS tn
               FROM {_BINARY}) c"""),
)
def binary_metrics(spark, sf_dir) -> DataFrame:
    rows = prep.drop_null_labels(network_flows(spark, sf_dir)).select(
        (F.trim("Label") != "BENIGN").cast("int").alias("actual"),
        F.coalesce((F.col("Flow Packets/s") > 1000).cast("int"), F.lit(0)).alias("predicted"),
    )
    found = metrics.binary_metrics(rows, "actual", "predicted")
    rates = [c for c in found.columns if c not in ("tp", "fp", "fn", "tn")]
    return found.withColumns({c: F.round(c, 6) for c in rates})


@query(
    "classification_report",
    flows(f"""SELECT * FROM (WITH cells AS (SELECT actual, predicted, count(*) AS n FROM {_PAIRS} GROUP BY ALL),
      classes AS (SELECT actual AS class FROM cells UNION SELECT predicted FROM cells),
      per AS (SELECT class, coalesce((SELECT sum(n) FROM cells WHERE actual=class),0)::BIGINT AS support,
        coalesce((SELECT sum(n) FROM cells WHERE predicted=class),0)::BIGINT AS taken,
        coalesce((SELECT sum(n) FROM cells WHERE predicted=class AND actual=class),0)::BIGINT AS hit FROM classes),
      scored AS (SELECT class, coalesce(hit/nullif(taken,0),0) AS precision, coalesce(hit/nullif(support,0),0) AS recall,
        coalesce(2*hit/nullif(taken+support,0),0) AS f1, support, hit FROM per)
      SELECT class, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, support FROM scored
      UNION ALL SELECT 'accuracy', round(sum(hit)/sum(support),6), round(sum(hit)/sum(support),6), round(sum(hit)/sum(support),6),
        sum(support)::BIGINT FROM scored
      UNION ALL SELECT 'macro avg', round(avg(precision),6), round(avg(recall),6), round(avg(f1),6), sum(support)::BIGINT FROM scored
      UNION ALL SELECT 'weighted avg', round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6),
        round(sum(f1*support)/sum(support),6), sum(support)::BIGINT FROM scored) r"""),
)
def classification_report(spark, sf_dir) -> DataFrame:
    report = metrics.classification_report(_severity_pairs(spark, sf_dir), "actual", "predicted")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})
