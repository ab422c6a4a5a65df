"""The alert chain: log events to remediated alerts, as one plan."""

from pyspark.sql import DataFrame

from palisade import fixed
from palisade.operators import class_model
from palisade.operators import predict as P
from palisade.operators.detect import HOT_ROWS, detect, with_history
from palisade.operators.intel import enrich
from palisade.operators.investigate import investigate
from palisade.operators.respond import respond


def rule_alerts(logs: DataFrame, hot: DataFrame | list | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Rule path: detect, investigate by rule, enrich, respond."""
    return respond(enrich(investigate(detect(with_history(logs, hot=hot, limit=limit)))))


def predicted_alerts(logs: DataFrame, model: DataFrame | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Sequence path: the next-event model fills the prediction that enrichment may use; fitted here when not given."""
    alerts = detect(with_history(logs, recent=fixed.SEQUENCE_LENGTH, limit=limit))
    model = P.fit(alerts) if model is None else model
    return respond(enrich(investigate(alerts, model)))


def class_alerts(logs: DataFrame, model: class_model.ClassModel, limit: int = HOT_ROWS) -> DataFrame:
    """Class path: the attack class model over the last events of the address fills prediction and narrative."""
    alerts = detect(with_history(logs, recent=model.length, limit=limit))
    return respond(enrich(class_model.investigate(alerts, model)))
