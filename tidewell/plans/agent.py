"""Answering questions from retrieved context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.text import prompt
from tidewell.operators.context import SOURCES_HEADING, cited_context, context, source_list
from tidewell.operators.generate import (
    MAX_LENGTH,
    Generator,
    extractive_answer,
    generate_distinct,
    generated_answer,
)
from tidewell.workspace import Workspace


def with_context(questions: DataFrame, hits: DataFrame, cited: bool = False) -> DataFrame:
    """Questions with their context, source list, nearest chunk and prompt.

    A question without any hit keeps an empty context. ``hits`` holds at most
    k rows per question.
    """
    rank, source, text = F.col("rank"), F.col("source_file"), F.col("chunk_text")
    joined = cited_context(rank, source, text) if cited else context(rank, text)
    per_question = hits.groupBy("query_id").agg(
        joined.alias("context"),
        source_list(rank, source).alias("_sources"),
        F.min_by(text, rank).alias("best_chunk"),
    )
    return (
        questions.select("query_id", "question")
        .join(per_question, "query_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
        .withColumn("prompt", prompt(F.col("context"), F.col("question")))
    )


def _answer(generator: Callable[[], Generator] | None) -> Column:
    if generator is None:
        return extractive_answer(F.col("best_chunk"))
    return generated_answer(F.col("prompt"), generator)


def answer_questions(
    questions: DataFrame,
    hits: DataFrame,
    generator: Callable[[], Generator] | None = None,
) -> DataFrame:
    """``(query_id, question, prompt, answer)``."""
    prepared = with_context(questions, hits)
    return prepared.withColumn("answer", _answer(generator)).select(
        "query_id", "question", "prompt", "answer"
    )


def answer_generated(
    questions: DataFrame,
    hits: DataFrame,
    generator: Callable[[], Generator],
    workspace: Workspace,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """``(query_id, question, prompt, answer, failure)`` of a model, asked each prompt once.

    Prompts are staged, so a lost task asks again only what it had not finished.
    """
    prepared = with_context(questions, hits).select("query_id", "question", "prompt")
    staged = workspace.stage(prepared, "prompts")
    return generate_distinct(staged, "prompt", workspace, generator, max_length)


def answer_with_sources(
    questions: DataFrame,
    hits: DataFrame,
    generator: Callable[[], Generator] | None = None,
) -> DataFrame:
    """Answers from cited context, and the response that lists the sources."""
    return (
        with_context(questions, hits, cited=True)
        .withColumn("answer", _answer(generator))
        .withColumn(
            "response", F.concat("answer", F.coalesce("_sources", F.lit(SOURCES_HEADING)))
        )
        .select("query_id", "question", "context", "answer", "response")
    )
