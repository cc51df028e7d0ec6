"""Measuring retrieval and answers against a question set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.config import DEFAULTS, Config
from tarn.functions.text import answer_is_correct, cost_usd, is_refusal
from tarn.operators import answering, retrieval
from tarn.storage import materialize


def grades(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``answers`` (``question_id``, ``answer``, ...) with ``type``, ``refused`` and ``correct``."""
    known = questions.select("question_id", "type", "must_contain")
    graded = answers.join(known, "question_id").withColumn("refused", is_refusal(F.col("answer")))
    return graded.withColumn("correct", answer_is_correct(F.col("type"), F.col("answer"), F.col("must_contain"))).drop("must_contain")


def retrieval_hits(first: DataFrame, questions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(question_id, *by, top1, top5)`` of questions that expect documents: whether the first, and any of the first five, is expected.

    ``first``: ``(question_id, *by, document_url, place)``. Without ``by``, questions with nothing retrieved count as misses.
    """
    by = by or []
    expected = questions.filter(F.size("expect_article_ids") > 0).select("question_id", "expect_article_ids")
    rows = expected.join(first, "question_id", "inner" if by else "left")
    hit = F.coalesce(F.array_contains("expect_article_ids", F.col("document_url")), F.lit(False))
    return rows.groupBy("question_id", *by).agg(F.max(hit & (F.col("place") == 1)).alias("top1"), F.max(hit & (F.col("place") <= 5)).alias("top5"))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def answer_metrics(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of graded answers: correct ones, unanswerable ones, refusals among these, tokens and dollars."""
    prompt, completion = (F.coalesce(F.sum(F.col("token_usage")[c]), F.lit(0)) for c in ("prompt_tokens", "completion_tokens"))
    return graded.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), _count(F.col("correct")).alias("answer_hits"), _count(F.col("type") == "unanswerable").alias("unanswerable_total"),
        _count((F.col("type") == "unanswerable") & F.col("refused")).alias("refusal_hits"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.round(cost_usd(prompt, completion), 8).alias("cost_usd"),
    )


def mean_seconds(timings: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: the mean of timed questions, 0.0 of none."""
    return timings.agg(F.coalesce(F.avg(seconds), F.lit(0.0)).alias("avg_seconds_per_query"))


def evaluate(corpus: DataFrame, questions: DataFrame, config: Config = DEFAULTS, mode: str | None = None, client: Callable = answering.first_excerpt_client, dim: int = 64) -> DataFrame:
    """One row: a question set answered from a corpus and measured.

    Whatever mode answers, retrieval is graded by the plain vector ranking. Hits are counted over questions
    that expect documents, refusals over unanswerable ones, answers over all. The model is called once a
    question with evidence: its answers are written before they are graded.
    """
    corpus = retrieval.corpus_table(corpus)
    tiered = retrieval.retrieve(corpus, questions, config, mode, dim=dim)
    answers = materialize(answering.ask(tiered, questions, client).withColumnRenamed("usage", "token_usage"), "answers")
    graded = grades(answers, questions)
    ranked = retrieval.vector_ranked(corpus, questions, config.raw_fetch_k, config, dim)
    hits = retrieval_hits(retrieval.first_documents(ranked), questions).agg(F.count("*").alias("retrieval_graded"), _count(F.col("top1")).alias("top1_hits"), _count(F.col("top5")).alias("top5_hits"))
    both = mean_seconds(answers)
    return answer_metrics(graded).crossJoin(F.broadcast(hits)).crossJoin(F.broadcast(both)).na.fill(0)  # one row each


def report(row: dict) -> list[str]:
    """The lines that a run of ``evaluate`` is shown as."""
    share = lambda part, whole: f"({round(100 * part / whole)}%)" if whole else "(n/a)"
    total, graded = row["total"], row["retrieval_graded"]
    return [
        f"Questions: {total}",
        f"First document expected: {row['top1_hits']}/{graded} {share(row['top1_hits'], graded)}",
        f"One of five expected: {row['top5_hits']}/{graded} {share(row['top5_hits'], graded)}",
        f"Answers correct: {row['answer_hits']}/{total} {share(row['answer_hits'], total)}",
        f"Refused correctly: {row['refusal_hits']}/{row['unanswerable_total']}",
        f"Cost: ${row['cost_usd']:.4f}, ${row['cost_usd'] / total if total else 0:.5f} a question",
        f"Time: {row['avg_seconds_per_query']:.2f} seconds a question, without pauses",
    ]
