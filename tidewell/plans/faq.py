"""The one best entry of a small knowledge table for each question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidewell.functions.text import clean_text
from tidewell.operators.embed import Encoder, HashedWords, embed
from tidewell.operators.knn import find_nearest
from tidewell.operators.lookup import fetch_hits
from tidewell.plans.retrieval import encode_questions


def nearest_entry(
    questions: DataFrame,
    entries: DataFrame,
    encoder: Callable[[], Encoder] = HashedWords,
    clean_queries: bool = True,
) -> DataFrame:
    """``(query_id, id, topic, content, squared_l2)`` of the nearest entry.

    ``entries`` is ``(id, topic, content)``.
    """
    encoded = embed(
        entries.select("id", clean_text(F.col("content")).alias("_text")), "_text", encoder
    )
    hits = find_nearest(
        encode_questions(questions, encoder, clean_queries), encoded, 1, corpus_id="id"
    )
    return fetch_hits(
        hits, entries.withColumn("id", F.col("id").cast("bigint")), "id"
    ).select("query_id", "id", "topic", "content", "squared_l2")
