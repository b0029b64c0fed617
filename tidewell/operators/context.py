"""Assembling the retrieved rows of each question.

The columns below are aggregates over the hits of one question, which are at
most k rows. A missing source or text is shown as nothing; its row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How retrieved texts and their sources are set out.
CONTEXT_SEPARATOR = "\n\n"
SOURCES_HEADING = "\n\n**Sources:**"


def _in_rank_order(rank: Column, text: Column, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), text.alias("text"))))
    return F.array_join(F.transform(rows, lambda row: row["text"]), separator)


def context(rank: Column, text: Column) -> Column:
    """Retrieved texts, best first."""
    return _in_rank_order(rank, text, CONTEXT_SEPARATOR)


def cited_context(rank: Column, source_file: Column, text: Column) -> Column:
    """Retrieved texts, best first, each led by its source."""
    nothing = F.lit("")
    source, words = F.coalesce(source_file, nothing), F.coalesce(text, nothing)
    cited = F.concat(F.lit("["), source, F.lit("] "), words)
    return _in_rank_order(rank, cited, CONTEXT_SEPARATOR)


def source_list(rank: Column, source_file: Column) -> Column:
    """The source of every retrieved row, repeats kept, below a heading."""
    line = F.concat(F.lit("\n- *"), F.coalesce(source_file, F.lit("")), F.lit("*"))
    return F.concat(F.lit(SOURCES_HEADING), _in_rank_order(rank, line, ""))
