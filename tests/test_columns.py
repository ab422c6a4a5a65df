"""Column expressions on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from palisade import fixed
from palisade.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("event", fixed.HIGH_EVENTS + fixed.MEDIUM_EVENTS + ["failed_login", "other", None])
def test_rule_severity(spark, event):
    want = "HIGH" if event in fixed.HIGH_EVENTS else "MEDIUM" if event in fixed.MEDIUM_EVENTS else "LOW"
    assert one(spark, C.rule_severity(text(event))) == want


@pytest.mark.parametrize(
    "prediction, score, want", [(-1, -0.5, "HIGH"), (-1, -0.15, "MEDIUM"), (-1, -0.1, "MEDIUM"), (1, -0.9, "LOW")]
)
def test_anomaly_severity(spark, prediction, score, want):
    assert one(spark, C.anomaly_severity(F.lit(prediction), F.lit(score))) == want


@pytest.mark.parametrize(
    "label, basic, rich",
    [
        ("BENIGN", "LOW", "LOW"),
        ("PortScan", "MEDIUM", "MEDIUM"),
        ("Web Attack � Brute Force", "HIGH", "HIGH"),
        ("Web Attack � Sql Injection", "HIGH", "HIGH"),
        ("Infiltration", "HIGH", "HIGH"),
        ("DDoS", "CRITICAL", "CRITICAL"),
        ("Bot", "CRITICAL", "CRITICAL"),
        ("DoS Hulk", "MEDIUM", "CRITICAL"),
        ("Heartbleed", "MEDIUM", "CRITICAL"),
        ("SSH-Patator", "MEDIUM", "MEDIUM"),
        ("ddos", "MEDIUM", "MEDIUM"),
        (None, "MEDIUM", "MEDIUM"),
    ],
)
def test_label_severity(spark, label, basic, rich):
    assert one(spark, C.label_severity(text(label), "basic")) == basic
    assert one(spark, C.label_severity(text(label), "rich")) == rich


def test_severity_code(spark):
    assert [one(spark, C.severity_code(F.lit(s))) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL", "odd")] == [0, 1, 2, 3, 0]
    assert one(spark, C.severity_code(F.lit("odd"), None)) is None


@pytest.mark.parametrize("value", [math.inf, -math.inf, math.nan, 1.5, None])
def test_cleaning(spark, value):
    c = F.lit(value).cast("double")
    finite = value is not None and math.isfinite(value)
    assert one(spark, C.clean_to_null(c)) == (value if finite else None)
    zero = 0.0 if value is not None and math.isinf(value) else value if finite else None
    assert one(spark, C.infinite_to_zero(c)) == zero


@pytest.mark.parametrize("value, want", [(0.0, "0.0"), (12.34, "12.3"), (99.96, "100.0"), (100.0, "100.0")])
def test_one_decimal(spark, value, want):
    assert one(spark, C.one_decimal(F.lit(value))) == want


@pytest.mark.parametrize("n, want", [(2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0, 0.0, 0.0])])
def test_align(spark, n, want):
    assert one(spark, C.align(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), n)) == want


@pytest.mark.parametrize("name, sentence", fixed.ATTACK_CONTEXT)
def test_known_context(spark, name, sentence):
    assert one(spark, C.attack_context(F.lit(name))) == sentence


def test_other_contexts(spark):
    sentences = dict(fixed.ATTACK_CONTEXT)
    assert one(spark, C.attack_context(F.lit("heavy ddos wave"))) == sentences["DDoS"]
    assert one(spark, C.attack_context(F.lit("robot portscan"))) == sentences["PortScan"]  # earlier in the table than Bot
    assert one(spark, C.attack_context(F.lit("x"))) == fixed.UNKNOWN_CONTEXT % "x"


def test_times(spark):
    assert one(spark, C.iso_utc(F.lit(1704067207.179575))) == "2024-01-01T00:00:07.179575+00:00"
    assert one(spark, C.iso_utc(F.lit(1704067207.0))) == "2024-01-01T00:00:07+00:00"
    assert one(spark, C.iso_utc(F.lit(1720000000.5))) == "2024-07-03T09:46:40.500000+00:00"
    seconds = spark.range(1).select(
        F.unix_micros(C.alert_time(F.lit(1704067207.179575))),
        F.abs(F.unix_micros(C.alert_time(F.lit("soon"))) - F.unix_micros(F.current_timestamp())),
        F.abs(F.unix_micros(C.alert_time(F.lit(None).cast("double"))) - F.unix_micros(F.current_timestamp())),
    )
    assert tuple(seconds.first()) == (1704067207179575, 0, 0)


def test_incident_id(spark):
    assert one(spark, C.incident_id(F.lit(17).cast("bigint"))) == "INC-70EFDF2E"


def test_normalize_label(spark):
    spellings = ["Web Attack – XSS", "Web Attack � XSS", " web attack - xss "]
    assert {one(spark, C.normalize_label(F.lit(s))) for s in spellings} == {"web attack - xss"}


def test_flow_defaults_and_vectors_cover_the_features():
    assert all(len(v) == len(fixed.FLOW_FEATURES) for _, v in fixed.EVENT_FLOW_DEFAULTS)
    assert all(len(v) == len(fixed.SEQUENCE_FEATURES) for _, v in fixed.EVENT_VECTORS)
    assert (len(fixed.TECHNIQUES), len(fixed.KEYWORD_TECHNIQUES), len(fixed.ATTACK_CONTEXT)) == (20, 9, 15)
