"""Text expressions: cleaning, previews and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# They decide what cleaned text looks like.
TAG_PATTERN = r"<[^>]++>"
WHITESPACE_PATTERN = r"(?U)[\s\x1c-\x1f]+"
PREVIEW_CHARS = 100

# The prompt wording an answer generator receives.
INSTRUCTION = (
    "Answer the question based on the context below. "
    'If the answer is not in the context, say "I don\'t know".'
)
CONTEXT_LABEL = "Context:"
QUESTION_LABEL = "Question:"
ANSWER_LABEL = "Answer:"
NO_ANSWER = "I don't know"


def clean_text(text: Column) -> Column:
    """Drop tags, collapse whitespace, trim, lower-case; NULL becomes ``""``.

    The whitespace class spans the Unicode spaces and the four separator
    control characters, and nothing replaces a removed tag.
    """
    untagged = F.regexp_replace(F.coalesce(text, F.lit("")), TAG_PATTERN, "")
    return F.lower(F.trim(F.regexp_replace(untagged, WHITESPACE_PATTERN, " ")))


def preview(source_file: Column, text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """One line naming the source and the start of a retrieved text."""
    return F.concat(
        F.lit("Found in "), source_file, F.lit(": "), F.substring(text, 1, chars), F.lit("...")
    )


def prompt(context: Column, question: Column) -> Column:
    """Instruction, context and question, one below the other."""
    return F.concat_ws(
        "\n",
        F.lit(INSTRUCTION),
        F.lit(""),
        F.lit(CONTEXT_LABEL),
        F.coalesce(context, F.lit("")),
        F.lit(""),
        F.lit(QUESTION_LABEL),
        F.coalesce(question, F.lit("")),
        F.lit(""),
        F.lit(ANSWER_LABEL),
    )
