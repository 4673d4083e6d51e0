"""Typed rows from JSON answers, second-source parties and evidence pages."""

from pyspark.sql import functions as F

from decretum.functions import text as T
from decretum.operators import fusion as U
from decretum.operators import payloads as Y

PAGES = "record_id string, page int, chunk_id string, text string"


def answers(spark, *texts):
    return spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "record_id string, json string")


def pages(spark, record, *texts):
    return spark.createDataFrame([(record, i, f"p{i}", t) for i, t in enumerate(texts, 1)], PAGES)


def test_damaged_and_odd_answers_give_no_rows_or_absent_values(spark):
    p = answers(
        spark, None, "", "no json at all", '{"case_details": {"court": "High Court"', '[1, 2]', "{}",
        '{"case_details": "text", "confidence": "high", "action_items": {"title": "x"}, "key_directions_orders": [7, null, {"text": " "}]}',
    )
    none = pages(spark, "r0", "Nothing here")
    rows = Y.case_fields(p, none).collect()
    assert {r.record_id for r in rows} == {"r5", "r6"} and len(rows) == 22
    assert all(r.value is None and r.confidence == 0 and r.notes == [Y.NOTE_EMPTY] and r.requires_review for r in rows)
    assert Y.case_actions(p, none).count() == 0 and Y.case_directions(p, none).count() == 0
    assert Y.enrichment_fields(p).count() == 0


def test_lists_take_names_and_equal_quotes_share_their_page(spark):
    p = answers(spark, '{"case_details": {"court": "High Court", "bench": ["A. Rao", {"name": "B. Sen"}, {"role": "clerk"}, ""], "advocates": {"name": "C. Das"}, '
                       '"evidence_snippet": "before A. Rao and B. Sen"}, "confidence": 0.9}')
    got = {r.field: r for r in Y.case_fields(p, pages(spark, "r0", "Title", "Heard before A. Rao and B. Sen today")).collect()}
    assert got["bench"]["items"] == ["A. Rao", "B. Sen"] and got["advocates"]["items"] == ["C. Das"]
    assert got["court"].evidence_page == got["bench"].evidence_page == 2 and not got["court"].requires_review
    assert got["parties"].value is None and got["parties"].evidence_page is None


def test_backing_prefers_own_evidence_then_the_lowest_source(spark):
    ask = spark.createDataFrame(
        [("r", "1", "a", "pay the full cost"), ("r", "2", "b", "pay the full cost"), ("r", "3", "a", None), ("r", "4", "c", " "), ("r", "5", "c", "absent words only"), ("q", "6", "a", "pay the full cost")],
        "record_id string, request_id string, target string, snippet string")
    src = spark.createDataFrame(
        [("r", None, 2, "We pay the full cost now", 12), ("r", None, 1, "They pay the full cost", 11), ("r", None, 0, "They pay the full cost", 10), ("r", "a", 5, "PAY THE FULL COST", 20), ("r", "b", 0, None, 30)],
        "record_id string, target string, source_no int, source_snippet string, n int").withColumn("evidence", F.struct("n"))
    got = {r.request_id: (r.backed and r.backed.n, r.supported) for r in Y.backing_evidence(ask, src).collect()}
    assert got == {"1": (20, True), "2": (10, True), "3": (None, True), "4": (None, False), "5": (None, False), "6": (None, False)}


def test_roles_consistent(spark):
    df = spark.createDataFrame(
        [(["Ram Lal"], ["Shri Ram Lal", "State"]), (["Ram Lal", "Nobody"], ["Ram Lal"]), ([], ["x"]), (["x"], []), (["Al"], ["Alexander the Great"])],
        "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.roles_consistent(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, False]


def test_pages_of_a_payload(spark):
    p = answers(spark, '{"evidence_pages": {"court": 3, "bench": "x"}}', '{"case_details": {"evidence_pages": [{"page": 2}, {"page_number": "5"}]}}',
                '{"directions": [{"text": "a", "page": 4}, {"source_page": "7"}, "b"]}', '{"evidence_pages": []}', '{"evidence_pages": "all"}', "not json", None)
    got = [r[0] for r in p.orderBy("record_id").select(U.payload_pages(F.col("json"))).collect()]
    assert got[0] == {"court": 3} and got[1]["court"] == 2 and got[1]["disposition"] == 5 and got[2] == {"directions": 7}
    assert got[3:] == [{}, {}, {}, {}]
