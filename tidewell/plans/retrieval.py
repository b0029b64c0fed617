"""Questions in, ranked chunks out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidewell.functions.text import clean_text
from tidewell.operators.embed import Encoder, HashedWords, embed
from tidewell.operators.knn import DEFAULT_K, find_nearest
from tidewell.operators.lookup import fetch_hits


def encode_questions(
    questions: DataFrame,
    encoder: Callable[[], Encoder] = HashedWords,
    clean_queries: bool = True,
) -> DataFrame:
    """``(query_id, embedding)`` of ``(query_id, question)``.

    Questions are cleaned like the corpus unless ``clean_queries`` is off.
    """
    text = clean_text(F.col("question")) if clean_queries else F.col("question")
    return embed(questions.select("query_id", text.alias("_text")), "_text", encoder).select(
        "query_id", "embedding"
    )


def retrieve(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = DEFAULT_K,
    encoder: Callable[[], Encoder] = HashedWords,
    clean_queries: bool = True,
    texts: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` nearest chunks of each question, with their text and rank.

    ``vectors`` is the vector layer; it should be a written table, as its
    vectors and its text are read separately. ``texts`` is the chunk layer, which is
    made for fetching texts by id; without it they come from the vector layer.
    """
    hits = find_nearest(encode_questions(questions, encoder, clean_queries), vectors, k)
    texts = (vectors if texts is None else texts).select("chunk_id", "source_file", "chunk_text")
    return fetch_hits(hits, texts, "chunk_id").select(
        "query_id", "rank", "chunk_id", "source_file", "chunk_text", "squared_l2", "l2"
    )
