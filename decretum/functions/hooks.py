"""Places where a user's own model or extractor joins a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_texts(requests: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]], *, max_parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers of a text model for every request, and the new cache rows.

    Cached answers are reused; of the rest each distinct request is sent once.
    ``model`` maps a list of prompts to a list of answers and runs inside the
    tasks; ``max_parallel`` bounds how many run at a time.
    """
    from decretum.operators.duplicates import request_key, response_cache
    from decretum.sources.tables import settle

    keyed = request_key(requests)
    hits, misses = response_cache(keyed, cache)
    todo = misses.select("request_key", "messages").dropDuplicates(["request_key"])
    if max_parallel:
        todo = todo.repartition(max_parallel, "request_key")

    def run(batches: Iterator):
        for batch in batches:
            batch = batch.copy()
            batch["raw_response"] = model(list(batch["messages"]))
            yield batch[["request_key", "raw_response"]]

    fresh = settle(todo.mapInPandas(run, "request_key string, raw_response string"))
    answers = hits.unionByName(misses.join(fresh, "request_key"))
    return answers, fresh


def extract_from_pages(pages: DataFrame, extractor: Callable, schema: str) -> DataFrame:
    """Rows of a user's page extractor.

    ``extractor`` takes a pandas frame of pages and returns one with the
    columns of ``schema``; it sees pages batch by batch, never a whole record.
    """

    def run(batches: Iterator):
        for batch in batches:
            yield extractor(batch)

    return pages.mapInPandas(run, schema)


def page_result_fields(results: DataFrame) -> DataFrame:
    """Page results of an extractor as one field row per record."""
    from decretum.operators.fusion import merge_page_results

    return merge_page_results(results).withColumn("items", F.lit(None).cast("array<string>"))
