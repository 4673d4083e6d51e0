"""The overall confidence takes the model's own score and a plan's wish for more context with it."""

import pytest
from pyspark.sql import functions as F

from decretum.operators import metrics as M


def test_answers_count_with_fields_and_actions(spark):
    records = spark.range(8).select(F.col("id").alias("record_id"))
    fields = spark.createDataFrame([(0, "court", 0.8), (0, "bench", 0.1), (1, "parties", 0.6), (7, "court", 0.65)], "record_id long, field string, confidence double")
    actions = spark.createDataFrame([(0, 0.6), (1, 0.0), (7, 1.0)], "record_id long, confidence double")
    details = spark.createDataFrame([(0, '{"confidence": 0.4}'), (1, '```json\n{"confidence": "0.9"}\n```'), (2, '{"confidence": "high"}'), (3, "no answer"), (4, '{"confidence": 0.3}')], "record_id long, json string")
    said = ["true", "false", "null", "1", "[]", '"yes"', "{}", '""']
    plans = spark.createDataFrame([(i, f'{{"needs_more_context": {x}}}') for i, x in enumerate(said)], "record_id long, json string")
    out = {r["record_id"]: r["overall_confidence"] for r in M.overall_confidence(records, fields, actions, details=details, plans=plans).collect()}
    # (0.8 + 0.6 + 0.4 + 0.4) / 4, (0.6 + 0.9) / 2, none, 0.4, 0.3, 0.4, none, and a tie that goes to the even digit
    assert out == pytest.approx({0: 0.55, 1: 0.75, 2: 0.0, 3: 0.4, 4: 0.3, 5: 0.4, 6: 0.0, 7: 0.82})
