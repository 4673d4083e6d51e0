"""The patterns of an action read each distinct direction text once, and every direction gets its parts."""

from pyspark.sql import functions as F

from decretum.operators import actions as A


def _directions(spark):
    said = F.when(F.col("id") % 3 == 0, "The Board shall pay compensation within 3 weeks").when(F.col("id") % 3 == 1, "The Registry shall issue notice")
    return spark.range(900).select(F.col("id").alias("record_id"), F.lit(0).alias("direction_index"), said.alias("value"), F.array().cast("array<struct<source_quality:string,bbox:array<double>>>").alias("evidence"))


def test_a_text_is_read_once_however_many_directions_have_it(spark):
    rows = _directions(spark)
    parts = A.direction_parts(rows).orderBy("value").collect()
    assert [r["value"] for r in parts] == ["The Board shall pay compensation within 3 weeks", "The Registry shall issue notice"]
    assert parts[0]["_who"]["owner"] == "Board" and parts[0]["_said"]["days"] == 21 and parts[0]["_marks"]["rule"] == "payment_release"


def test_every_direction_has_its_action(spark):
    rows = _directions(spark)
    context = spark.range(0, 900, 2).select(F.col("id").alias("record_id"), F.lit("WP 1").alias("case_number"), F.to_date(F.lit("2024-01-01")).alias("judgment_date"), F.lit("dismissed").alias("disposition"))
    # evidence of the full type is cast by name, so the narrow test rows give it as nulls
    wide = rows.withColumn("evidence", F.array().cast(f"array<{A.EVIDENCE_TYPE}>"))
    out = {r["record_id"]: r for r in A.directions_to_actions(wide, context).collect()}
    assert len(out) == 900
    assert str(out[0]["timeline"]["due_date"]) == "2024-01-22" and out[3]["timeline"]["due_date"] is None and out[3]["timeline"]["raw_text"] == "within 3 weeks"
    assert out[0]["category"] == "payment_release" and out[0]["confidence"] == 0.8
    assert out[4]["category"] == "appeal_consideration" and out[1]["category"] == "legal_review" and out[1]["timeline"]["timeline_type"] == "missing"
    assert out[2]["title"] is None and out[2]["category"] == "appeal_consideration" and "owner_unclear" in out[2]["ambiguity_flags"]
