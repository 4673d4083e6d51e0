"""All High Courts that a record's fields name are kept, and each name is read as it stands."""

from pyspark.sql import functions as F

from decretum.operators import actions as A


def test_no_named_high_court_is_dropped(spark):
    rows = [
        (1, "court", "High Court of Kerala", "IN THE HIGH COURT OF KERALA", ["Appeal from the High Court of Delhi."]),
        (1, "respondents", "High Court of Bombay; State", None, ["the High  Court of Madras, by order", "no court"]),
        (2, "court", "High Court of Kerala", None, ["high court of kerala"]),
        (3, "disposition", "High Court of Delhi", None, ["High Court of Delhi"]),
    ]
    made = spark.createDataFrame(rows, "record_id long, field string, value string, raw_value string, said array<string>")
    fields = made.select("record_id", "field", "value", "raw_value", F.lit(None).cast("array<string>").alias("items"), F.transform("said", lambda s: F.struct(s.alias("snippet"))).alias("evidence"))
    out = {r["record_id"]: r["named_courts"] for r in A.record_high_courts(fields).collect()}
    assert [c.lower() for c in out[1]] == [f"high court of {p}" for p in ("bombay", "delhi", "kerala", "madras")]
    assert [c.lower() for c in out[2]] == ["high court of kerala"] and 3 not in out
