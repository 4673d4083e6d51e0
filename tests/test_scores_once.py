"""Scores read each line and each date text once."""

from pyspark.sql import functions as F

from decretum.catalog import evaluation as E
from decretum.operators import evaluation as V


def test_the_lines_are_numbered_before_the_scores(spark):
    plan = E._per_file(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "lineitem" not in plan


def test_a_date_text_is_read_once(spark):
    wanted = spark.createDataFrame(
        [(1, "judgment_date", "3 May 2001"), (2, "judgment_date", " 2001-5-3 "), (3, "judgment_date", None), (4, "judgment_date", ""), (5, "judgment_date", "soon"), (6, "judgment_date", "3 May 2001"), (1, "court", "3 May 2001")],
        "file_name int, field string, expected string",
    ).withColumns({"expected_items": F.lit(None).cast("array<string>"), "is_list": F.lit(False)})
    found = spark.createDataFrame(
        [(1, "judgment_date", "2001-05-03"), (2, "judgment_date", "03-05-2001"), (4, "judgment_date", None), (5, "judgment_date", "SOON "), (6, "judgment_date", "2001-05-04"), (1, "court", "2001-05-03")],
        "file_name int, field string, value string",
    ).withColumn("items", F.lit(None).cast("array<string>"))
    out = V.score_fields(wanted, found)
    assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["file_name"], r["field"]): r["match"] for r in out.collect()}
    assert got == {(1, "judgment_date"): True, (2, "judgment_date"): True, (3, "judgment_date"): True, (4, "judgment_date"): True, (5, "judgment_date"): True, (6, "judgment_date"): False, (1, "court"): False}


def test_a_row_found_by_its_index_matches_only_without_texts(spark):
    given = "file_name int, idx int, title string, owner string, category string, priority string"
    wanted = spark.createDataFrame([(1, 0, "A", "x", "c", "p"), (1, 1, None, "x", "c", "p"), (1, 2, None, "x", "c", "p"), (1, 3, "D", "x", "c", "p"), (1, 4, "E", None, "c", "p")], given)
    actual = spark.createDataFrame([(1, 0, "B", "x", "c", "p"), (1, 1, None, "x", "c", "q"), (1, 2, "Z", "x", "c", "p"), (1, 7, " d ", "y", "c", "p")], given)
    rows = sorted((r["action_index"], r["title_match"], r["note"]) for r in V.score_actions(wanted, actual).collect())
    assert rows == [(0, False, "matched by index"), (1, True, "matched by title"), (2, False, "matched by index"), (3, True, "matched by title"), (4, False, "no matching action found")]


def test_scores_of_a_file_are_made_where_its_rows_were_dealt(spark, monkeypatch):
    plans = []
    real = E.settle
    monkeypatch.setattr(E, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    E._per_file(spark, "/root/testdata/sf0.001")
    shuffles = [line for line in plans[-1].splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("hashpartitioning(file_name" in line and ", " in line.split("hashpartitioning(")[1].split("),")[0].rsplit(", ", 1)[0] for line in shuffles), shuffles
