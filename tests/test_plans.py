"""Every registered query against its SQL, and what the plans of the main operators may contain."""

import re

import pytest
from compare import difference
from pyspark.sql import functions as F

from palisade.operators import analytics, pipeline, prep, sequences
from palisade.operators.detect import with_history
from palisade.plans import ORACLE, QUERIES
from palisade.sources.adapters import FLOW_KEY, network_flows, soc_logs


# The other stream queries replay for half a minute each; `python tests/compare.py` runs them, test_streams.py their jobs.
CHECKED = sorted(n for n in ORACLE if not n.startswith("stream_") or n == "stream_history")


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), sf, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


#: What these return depends on a fitted model; other tests check how it is fitted, test_scores_of_models what it says.
FITTED = {
    "boosted_losses", "class_predictions", "iforest_eval_scores", "intrusion_classifier_scores", "severity_classifier_scores",
    "alert_severity_classifier_scores",
}


def test_every_other_query_has_sql():
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) - set(ORACLE) == FITTED


@pytest.mark.parametrize("name", ["severity_classifier", "alert_severity_classifier"])
def test_scores_of_models(spark, sf, name):
    """A report's averages follow from its classes; severities of alerts can be told from their features."""
    rows = {r["class"]: r for r in QUERIES[f"{name}_scores"](spark, sf).collect()}
    own = [r for c, r in rows.items() if c not in ("accuracy", "macro avg", "weighted avg")]
    total = sum(r["support"] for r in own)
    for c in ("precision", "recall", "f1"):
        assert abs(rows["macro avg"][c] - sum(r[c] for r in own) / len(own)) < 1e-9
        assert abs(rows["weighted avg"][c] - sum(r[c] * r["support"] for r in own) / total) < 1e-9
    accuracy, base = rows["accuracy"]["recall"], max(r["support"] for r in own) / total
    assert abs(accuracy - rows["weighted avg"]["recall"]) < 1e-9
    if name == "alert_severity_classifier":
        assert accuracy > base + 0.05


def test_metrics_of_the_forest(spark, sf):
    r = QUERIES["iforest_eval_scores"](spark, sf).first()
    assert abs(r["precision"] - (r["tp"] / (r["tp"] + r["fp"]) if r["tp"] + r["fp"] else 0)) < 1e-9
    assert abs(r["recall"] - r["tp"] / (r["tp"] + r["fn"])) < 1e-9


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    # more queries join where the text folder is present
    assert set(contract.queries()) >= set(QUERIES) and set(contract.oracle_sql()) >= set(ORACLE)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+)", plan(df))


def test_rule_chain_needs_one_shuffle(spark, sf):
    logs = soc_logs(spark, sf).select("log_id", "timestamp", "event", "ip", "user")
    text = plan(pipeline.rule_alerts(logs, hot=[]))
    assert re.findall(r"\bExchange (\w+)", text) == ["hashpartitioning"]
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_history_columns_share_one_shuffle_and_sort(spark, sf):
    logs = soc_logs(spark, sf).select("log_id", "timestamp", "event", "ip")
    text = plan(with_history(logs, frequency=True, recent=5, hot=[]))
    assert len(re.findall(r"\bExchange ", text)) == 1 and len(re.findall(r"\bSort ", text)) == 1


def test_no_single_partition_in_sliced_order(spark, sf):
    logs = soc_logs(spark, sf).select("log_id", "timestamp", "event", "ip")
    assert "SinglePartition" not in plan(with_history(logs, frequency=True, recent=5, limit=0))
    rows = sequences.complete_rows(network_flows(spark, sf))
    profile = sequences.Profile(rows, limit=0)
    made = sequences.windows(sequences.encoded_flows(rows, profile), scope="global")
    assert "SinglePartition" not in plan(made)
    assert "SinglePartition" not in plan(prep.stratified_split(network_flows(spark, sf), FLOW_KEY))


def test_scans_read_only_what_they_need(spark, sf):
    logs = soc_logs(spark, sf)
    top = plan(analytics.top_addresses(logs))
    assert "ReadSchema: struct<user_id:bigint,props:string>" in top and "TakeOrderedAndProject" in top
    flows = plan(prep.label_counts(network_flows(spark, sf)))
    assert "ReadSchema: struct<l_partkey:bigint>" in flows


def test_dashboard_reads_the_stored_table(spark, sf):
    def formatted(name):
        execution = QUERIES[name](spark, sf)._jdf.queryExecution()
        return spark._jvm.PythonSQLUtils.explainString(execution, "formatted")

    page, stats = formatted("alerts_page_keyset"), formatted("alert_stats")
    assert "LessThan(log_id,900)" in page and re.search(r"PartitionFilters: .*stage#\d+ = remediated", page)
    assert "ReadSchema: struct<event:string,severity:string>" in stats
    for text in (page, stats):
        assert "Window" not in text and "Join" not in text and "event_id" not in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(soc_logs(spark, sf).filter(F.col("log_id") > 900))
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,900)]" in text
