"""Grounded answers to questions about a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decretum.functions import text as T

ACTION_WORDS = ("action", "do", "next", "deadline", "due")
PARTY_WORDS = ("party", "petitioner", "respondent")
SOURCE_FIELDS = {
    "parties": ["petitioners", "respondents", "parties"],
    "date": ["judgment_date"],
    "summary": ["case_number", "court", "disposition"],
}


def question_topic(question: Column) -> Column:
    low = F.lower(question)

    def any_of(words) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return hit

    return (
        F.when(any_of(ACTION_WORDS), "actions").when(any_of(PARTY_WORDS), "parties").when(any_of(("date", "when")), "date").otherwise("summary")
    )


def answer_questions(questions: DataFrame, fields: DataFrame, actions: DataFrame, cap: int | None = None) -> DataFrame:
    """Answer text and sources for each question.

    ``questions`` holds record_id, question_id and question; ``actions``
    holds due_date as a date. With ``cap`` only so many actions of a record are listed, and so many sources given.
    """
    asked = questions.withColumn("topic", question_topic(F.col("question")))
    names = ("case_number", "court", "disposition", "judgment_date", "petitioners", "respondents", "parties")
    shown = F.when(F.size(F.coalesce("items", F.array().cast("array<string>"))) > 0, F.array_join("items", ", ")).otherwise(F.col("value"))
    wide = fields.groupBy("record_id").agg(*[F.max(F.when(F.col("field") == n, T.null_if_blank(shown))).alias(n) for n in names])
    order = Window.partitionBy("record_id").orderBy("action_index", "action_id")
    first = _first(actions.withColumn("n", F.row_number().over(order)), cap)
    part = F.concat(
        F.coalesce("title", F.lit("Untitled action")), F.lit(" ["), F.coalesce("category", F.lit("uncategorized")), F.lit("], owner: "),
        F.coalesce(T.null_if_blank(F.col("responsible_department")), F.lit("owner unclear")), F.lit(", due: "),
        F.coalesce(F.date_format("due_date", "yyyy-MM-dd"), F.lit("no explicit due date")),
    )
    listed = first.groupBy("record_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda s: s["p"]), " | ").alias("action_text")
    )
    counts = actions.groupBy("record_id").agg(F.count("*").alias("n_actions"))
    rows = asked.join(wide, "record_id", "left").join(listed, "record_id", "left").join(counts, "record_id", "left")
    missing = F.lit("not extracted")
    answer = (
        F.when(
            F.col("topic") == "actions",
            F.coalesce(F.concat(F.lit(" Extracted action items: "), "action_text"), F.lit("No action items were extracted from this judgment.")),
        )
        .when(
            F.col("topic") == "parties",
            F.concat(F.lit("Petitioners: "), F.coalesce("petitioners", "parties", missing), F.lit(". Respondents: "), F.coalesce("respondents", missing), F.lit(".")),
        )
        .when(F.col("topic") == "date", F.concat(F.lit("Judgment date: "), F.coalesce("judgment_date", missing), F.lit(".")))
        .otherwise(
            F.concat(
                F.coalesce("case_number", F.lit("This judgment")), F.lit(" from "), F.coalesce("court", F.lit("the extracted court")), F.lit(" has disposition "),
                F.coalesce("disposition", F.lit("unknown")), F.lit(" and "), F.coalesce("n_actions", F.lit(0)).cast("string"), F.lit(" extracted action item(s)."),
            )
        )
    )
    quotes = _field_quotes(fields).unionByName(_action_quotes(first))
    top = Window.partitionBy("record_id", "topic").orderBy("o1", "o2")
    shown_quotes = _first(quotes.withColumn("n", F.row_number().over(top)), cap)
    sources = shown_quotes.groupBy("record_id", "topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "source", "page", "snippet"))), lambda s: F.struct(s["source"], s["page"], s["snippet"])).alias("sources")
    )
    out = rows.withColumn("answer", answer).join(sources, ["record_id", "topic"], "left")
    return out.select("record_id", "question_id", "topic", "answer", F.lit(True).alias("grounded"), "sources")


def _first(rows: DataFrame, cap: int | None) -> DataFrame:
    return rows if cap is None else rows.where(F.col("n") <= cap)


def _field_quotes(fields: DataFrame) -> DataFrame:
    places = [(t, n, i) for t, names in SOURCE_FIELDS.items() for i, n in enumerate(names)]
    tests = [F.when(F.col("field") == n, F.struct(F.lit(t).alias("topic"), F.lit(i).alias("o1"))) for t, n, i in places]
    rows = fields.select("field", "record_id", "evidence", F.explode(F.array_compact(F.array(*tests))).alias("t"))
    ev = rows.select("record_id", F.col("t.topic").alias("topic"), F.col("t.o1").alias("o1"), F.col("field").alias("source"), F.posexplode("evidence").alias("o2", "e"))
    return ev.select("record_id", "topic", F.col("o1").cast("long").alias("o1"), "o2", "source", F.col("e.page").alias("page"), F.col("e.snippet").alias("snippet"))


def _action_quotes(first: DataFrame) -> DataFrame:
    ev = first.select("record_id", F.lit("actions").alias("topic"), F.col("n").cast("long").alias("o1"), F.col("action_id").alias("source"), F.posexplode("evidence").alias("o2", "e"))
    return ev.select("record_id", "topic", "o1", "o2", "source", F.col("e.page").alias("page"), F.col("e.snippet").alias("snippet"))
