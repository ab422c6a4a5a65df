"""Flow preparation against numpy and pandas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade import fixed
from palisade.operators import iforest, metrics, models, prep
from palisade.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    data = {
        "a": rng.lognormal(0, 3, 5000),
        "b": rng.integers(0, 2, 5000).astype(float),
        "c": np.where(rng.random(5000) < 0.7, 5.0, rng.normal(size=5000)),
        "d": np.full(5000, 2.5),
    }
    rows = [tuple(None if i % 11 == 0 and k == "a" else float(data[k][i]) for k in data) for i in range(5000)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4), rows


@pytest.mark.parametrize("q", [0.0, 0.02, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("bracket", [100_000, 40])
def test_exact_quantiles(numbers, q, bracket):
    df, rows = numbers
    got = exact_quantiles(df, ["a", "b", "c", "d"], q, bracket_rows=bracket)
    for i, c in enumerate("abcd"):
        values = [r[i] for r in rows if r[i] is not None]
        assert math.isclose(got[c], float(np.quantile(values, q)), rel_tol=1e-12)


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), 1.0), (None, 4.0, float("inf"))], "a double, b double, c double")
    assert exact_quantiles(df, ["a", "b"]) == {"a": None, "b": 4.0}
    assert exact_quantiles(df, ["c"], 1.0) == {"c": float("inf")}


def test_impute_leaves_empty_columns_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (None, 4.0)], "a double, b double")
    got = prep.impute(df, prep.medians(df, ["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(None, 1.0), (None, 2.5), (None, 4.0)]


def test_scaler_uses_the_population_and_survives_constants(numbers):
    df, rows = numbers
    fitted = prep.scaler(df, ["c", "d"])
    assert math.isclose(fitted["c"][1], float(np.std([r[2] for r in rows])), rel_tol=1e-9)
    assert fitted["d"] == (2.5, 1.0)


def test_names_and_union(spark):
    one = spark.createDataFrame([(1, "x")], " a string, b string".replace("a string", "`a ` string"))
    two = spark.createDataFrame([("y",)], "`b ` string")
    got = prep.union_files([one, two])
    assert got.columns == ["a", "b"] and [tuple(r) for r in got.collect()] == [("1", "x"), (None, "y")]
    mixed = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert prep.numeric_columns(mixed) == ["a", "b"]


def test_label_codes(spark):
    rows = [(3, "b"), (1, " c "), (2, None), (5, "a")]
    df = spark.createDataFrame(rows, "k int, Label string")
    first = prep.label_mapping_first(df, ["k"]).orderBy("code").collect()
    assert [(r["label"], r["code"]) for r in first] == [("c", 0), ("nan", 1), ("b", 2), ("a", 3)]
    strange = [(1, "Web Attack � XSS"), (2, "Bot"), (3, "bot")]
    codes = prep.label_mapping(spark.createDataFrame(strange, "k int, Label string"))
    assert {r["label"]: r["code"] for r in codes.collect()} == {"Bot": 0, "Web Attack � XSS": 1, "bot": 2}
    known = spark.createDataFrame([("Bot", 1)], "label string, code int")
    back = prep.decode(spark.createDataFrame([(1,), (7,)], "code int"), known).orderBy("code").collect()
    assert [r["label"] for r in back] == ["Bot", "class_7"]
    hot = spark.range(1).select(prep.one_hot(F.lit(2), 4)).first()[0]
    assert hot == [0, 0, 1, 0]


def test_severity_dataset_row(spark):
    """The literal flow of five features keeps its values and gets its severity."""
    values = [500000.0, 200.0, 150.0, 12000.0, 8000.0]
    rows = [(*values, "DDoS"), (*values[:3], math.inf, -math.inf, " BENIGN "), (*values[:4], None, "Bot"), (*values, None)]
    schema = ", ".join(f"`{c}` double" for c in fixed.SEVERITY_SET_FEATURES) + ", Label string"
    got = prep.severity_dataset(spark.createDataFrame(rows, schema)).collect()
    assert [(*tuple(r)[:5], r["severity"]) for r in got] == [
        (*values, "CRITICAL"), (*values[:3], 0.0, 0.0, "LOW"), (*values, "MEDIUM"),
    ]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "actual int, predicted int")
    r = metrics.binary_metrics(df, "actual", "predicted").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["false_positive_rate"], r["detection_rate"]) == (1, 0, 0, 0, 0, 0)


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("c", "c")], "actual string, predicted string")
    got = {r["class"]: r for r in metrics.classification_report(df, "actual", "predicted").collect()}
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["support"]) == (0.0, 0.0, 1)
    assert math.isclose(got["a"]["precision"], 2 / 3)
    assert got["accuracy"]["f1"] == 0.75
    assert math.isclose(got["weighted avg"]["recall"], 0.75)


# --- isolation forest -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 2))
    x[:20] += 9.0
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, u double, v double")


def test_forest_finds_outliers_and_flags_its_share(spark, cloud, tmp_path):
    forest = iforest.fit(cloud, ["id"], ["u", "v"], contamination=0.02)
    scored = forest.score(cloud)
    far = scored.filter("id < 20").agg(F.max("anomaly_score")).first()[0]
    bulk = scored.filter("id >= 20").agg(F.avg("anomaly_score")).first()[0]
    assert far < bulk - 0.1
    assert scored.filter("id < 20 AND anomaly_prediction = -1").count() == 20
    assert abs(scored.filter("anomaly_prediction = -1").count() - 80) <= 1
    forest.save(str(tmp_path / "model"))
    again = iforest.Forest.load(spark, str(tmp_path / "model")).score(cloud)
    both = scored.select("id", "anomaly_score").join(again.select("id", F.col("anomaly_score").alias("s")), "id")
    assert both.filter("anomaly_score <> s").count() == 0


def test_forest_is_reproducible_and_full(spark, cloud):
    a = iforest.grow_forest(cloud, 4000, ["id"], ["u", "v"], trees=20).orderBy("tree", "node").collect()
    b = iforest.grow_forest(cloud.repartition(9), 4000, ["id"], ["u", "v"], trees=20).orderBy("tree", "node").collect()
    assert a == b and {r["tree"] for r in a} == set(range(20))
    assert max(r["length"] for r in a) < 8 + float(iforest.average_path(256))
    drawn = iforest._subsamples(cloud, 4000, ["id"], ["u", "v"], 20, 256, 42).groupBy("tree").count().collect()
    assert all(256 <= r["count"] <= 600 for r in drawn)


def test_scores_match_a_plain_walk(cloud):
    forest = iforest.fit(cloud, ["id"], ["u", "v"], trees=10, sample=64)
    nodes = {(r["tree"], r["node"]): r for r in forest.nodes.collect()}
    for r in forest.score(cloud).filter("id % 400 = 0").collect():
        x = [(r[c] - forest.scaler[c][0]) / forest.scaler[c][1] for c in ("u", "v")]
        total = 0.0
        for tree in range(10):
            node = nodes[tree, 0]
            while node["feature"] >= 0:
                node = nodes[tree, node["left"] if x[node["feature"]] <= node["cut"] else node["right"]]
            total += node["length"]
        assert math.isclose(r["anomaly_score"], -(2 ** (-total / 10 / float(iforest.average_path(64)))), rel_tol=1e-9)


def test_small_tables_use_every_row(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id bigint, u double")
    drawn = iforest._subsamples(df, 30, ["id"], ["u"], 100, 256, 42).groupBy("tree").count().collect()
    assert len(drawn) == 100 and {r["count"] for r in drawn} == {30}


# --- supervised models ------------------------------------------------------------------------------------------------


def test_severity_model_learns_and_reloads(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(float(i % 7), float(i % 3), 1.0, float(i), 0.0, "HIGH" if i % 7 > 3 else "LOW") for i in range(400)]
    schema = ", ".join(f"`{c}` double" for c in fixed.SEVERITY_SET_FEATURES) + ", severity string"
    df = spark.createDataFrame(rows, schema)
    model = models.fit_severity(df, trees=10, depth=4)
    model.write().overwrite().save(str(tmp_path / "m"))
    got = models.predictions(PipelineModel.load(str(tmp_path / "m")), df)
    assert got.filter("severity <> predicted").count() == 0


def test_boosted_intrusion_model(spark):
    rows = [(float(i % 3), float(i % 5), "abc"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "u double, v double, Label string")
    model = models.fit_boosted_intrusion(df, ["u", "v"], rounds=3)
    assert model.predict(df).filter("Label <> predicted").count() == 0


def test_test_set_is_prepared_with_training_values(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "u double")
    test = spark.createDataFrame([(None,), (math.inf,)], "u double")
    _, fitted = models.prepared_flows(train, features=["u"])
    got, _ = models.prepared_flows(test, fitted, ["u"])
    assert [r["u"] for r in got.collect()] == [0.0, 0.0]
