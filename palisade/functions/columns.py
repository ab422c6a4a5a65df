"""Column expressions: severities, texts, vectors and display forms. All of them stay on the JVM side."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import fixed


def or_unknown(c: Column) -> Column:
    """The value, or 'unknown' when it is missing or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def lookup(c: Column, table: dict) -> Column:
    """Value of a small fixed dictionary; null when absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), c)


# --- severity ---------------------------------------------------------------------------------------------------------


def rule_severity(event: Column) -> Column:
    return (
        F.when(event.isin(fixed.HIGH_EVENTS), "HIGH").when(event.isin(fixed.MEDIUM_EVENTS), "MEDIUM").otherwise("LOW")
    )


def anomaly_severity(prediction: Column, score: Column, high_below: float = fixed.ANOMALY_HIGH_BELOW) -> Column:
    """Severity of a forest prediction (-1 anomaly, 1 normal) with its score (lower is more anomalous)."""
    return F.when(prediction != -1, "LOW").when(score < high_below, "HIGH").otherwise("MEDIUM")


def label_severity(label: Column, rules: str) -> Column:
    """Severity of an attack label under the rule set `basic` or `rich`; null labels are MEDIUM."""
    chosen = F.when(label == "BENIGN", "LOW")
    for words, severity in fixed.SEVERITY_RULES[rules]:
        chosen = chosen.when(reduce(lambda a, b: a | b, [label.contains(w) for w in words]), severity)
    return chosen.otherwise("MEDIUM")


def severity_code(severity: Column, missing: int | None = 0) -> Column:
    return F.coalesce(lookup(severity, fixed.SEVERITY_CODES), F.lit(missing).cast("int"))


# --- numbers ----------------------------------------------------------------------------------------------------------


def infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def clean_to_null(c: Column) -> Column:
    """Infinities and NaN become null."""
    return F.when(~(infinite(c) | F.isnan(c)), c)


def infinite_to_zero(c: Column) -> Column:
    """Infinities become 0, NaN becomes null."""
    return F.when(infinite(c), 0.0).when(~F.isnan(c), c)


def one_decimal(c: Column) -> Column:
    """Non-negative number as text with one decimal."""
    tenths = F.floor(c * 10 + 0.5)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def percent(share: Column) -> Column:
    return F.concat(one_decimal(share * 100), F.lit("%"))


def align(vector: Column, n: int) -> Column:
    """Cut or zero-pad an array of numbers to exactly n entries."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), n)), 1, n)


# --- time and ids -----------------------------------------------------------------------------------------------------


def micros(seconds: Column) -> Column:
    return F.floor(seconds * 1e6 + 0.5).cast("bigint")


def alert_time(seconds: Column) -> Column:
    """Timestamp of epoch seconds; missing or non-numeric values become the processing time."""
    return F.coalesce(F.timestamp_micros(micros(seconds.cast("string").try_cast("double"))), F.current_timestamp())


def iso_utc(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC, whatever the session zone is."""
    us = micros(seconds)
    day = F.floor(us / 86_400_000_000)
    rest = ((us - day * 86_400_000_000) / 1e6).cast("decimal(18,6)")
    moment = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(day.cast("int"), secs=rest)
    text = moment.cast("string")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.when(F.length(text) > 19, F.concat(F.lit("."), fraction)).otherwise(""),
        F.lit("+00:00"),
    )


def incident_id(key: Column) -> Column:
    return F.concat(F.lit("INC-"), F.upper(F.substring(F.md5(key.cast("string")), 1, 8)))


# --- texts ------------------------------------------------------------------------------------------------------------


def rule_investigation(event: Column, severity: Column) -> Column:
    text = fixed.RULE_INVESTIGATION
    return (
        F.when(severity.isin("HIGH", "CRITICAL"), F.format_string(text["HIGH"], event))
        .when(severity == "MEDIUM", F.format_string(text["MEDIUM"], event))
        .otherwise(F.format_string(text["LOW"], event))
    )


def attack_context(attack: Column) -> Column:
    """Sentence for a predicted attack: exact name, else the first known name contained in it, else a review request."""
    exact = lookup(attack, dict(fixed.ATTACK_CONTEXT))
    partial = [
        F.when(F.contains(F.lower(attack), F.lit(name.lower())), F.lit(text)) for name, text in fixed.ATTACK_CONTEXT
    ]
    return F.coalesce(exact, *partial, F.format_string(fixed.UNKNOWN_CONTEXT, attack))


def prediction_text(attack: Column, confidence: Column, events: Column, ip: Column, model: str) -> Column:
    return F.concat(
        attack_context(attack),
        F.lit(f" ({model} predicted '"), attack, F.lit("' with "), percent(confidence),
        F.lit(" confidence based on last "), events.cast("string"), F.lit(" events from "), ip, F.lit(".)"),
    )


def normalize_label(label: Column) -> Column:
    """Fold dash variants, case and outer blanks, for joining label spellings of different sources."""
    return F.lower(F.trim(F.regexp_replace(label, "[–—�]", "-")))


def shown_event(event: Column) -> Column:
    return F.upper(F.replace(event, F.lit("_"), F.lit(" ")))


def shown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
