"""Retrieval and answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW_CHARS = 240


def recall_at_k(expected: Column, retrieved: Column) -> Column:
    """Share of distinct expected ids among the retrieved ones; nothing expected counts as 1.0."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, retrieved)) / F.size(want)).otherwise(1.0)


def keyword_coverage(keywords: Column, answer: Column) -> Column:
    """Share of non-blank keywords contained in the answer (case-insensitive; repeats count)."""
    real = F.filter(keywords, lambda k: k != "")
    low = F.lower(answer)
    hits = F.filter(real, lambda k: F.contains(low, F.lower(k)))
    return F.when(F.size(real) > 0, F.size(hits) / F.size(real)).otherwise(1.0)


def mean_or_null(values: Column) -> Column:
    return F.avg(values)


def score_questions(
    questions: DataFrame, filenames: DataFrame, responses: DataFrame, citations: DataFrame, top_k: int = 5
) -> DataFrame:
    """One scored row per question.

    ``questions``: ``query_id, question, expected_filenames, expected_keywords``; ``filenames``: ``filename,
    document_id``; ``responses``: ``query_id, answer, verdict, groundedness_score, intent``; ``citations``:
    ``query_id, rank, document_id``. Unknown file names are ignored; skipped verifications have no score.
    """
    expected = (
        questions.select("query_id", F.explode("expected_filenames").alias("filename")).join(filenames, "filename")
        .select("query_id", "document_id").distinct()
    )
    top = citations.filter(F.col("rank") <= top_k)
    found = expected.join(top.select("query_id", "document_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "document_id"], "left")
    recall = found.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
    ids = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id"))).alias("_ids"))
    scored = ~F.coalesce("verdict", F.lit("skipped")).isin("skipped", "")
    return (
        questions.join(responses, "query_id").join(recall, "query_id", "left").join(ids, "query_id", "left")
        .select(
            "query_id", "question", F.coalesce("recall", F.lit(1.0)).alias("recall"),
            keyword_coverage(F.col("expected_keywords"), F.col("answer")).alias("coverage"),
            F.when(scored, F.coalesce("groundedness_score", F.lit(0.0))).alias("groundedness"),
            F.coalesce("verdict", F.lit("skipped")).alias("verdict"), F.coalesce("intent", F.lit("chat")).alias("intent"),
            F.substring("answer", 1, PREVIEW_CHARS).alias("answer_preview"),
            F.coalesce(F.transform("_ids", lambda x: x["document_id"]), F.array().cast(f"array<{citations.schema['document_id'].dataType.simpleString()}>")).alias("retrieved_doc_ids"),
        )
    )


def summarise(results: DataFrame, top_k: int = 5) -> DataFrame:
    """One-row report: counts and averages (recall and coverage 0.0 when empty, groundedness null)."""
    return results.agg(
        F.count(F.lit(1)).alias("n_questions"), F.lit(top_k).alias("top_k"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("avg_recall_at_k"),
        F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("avg_keyword_coverage"),
        F.avg("groundedness").alias("avg_groundedness"), F.count("groundedness").alias("n_grounded"),
    )
