"""Cutting cleaned text into overlapping chunks.

Words are packed into chunks of at most ``size`` characters; a chunk starts
with as many whole words of the one before as fit into ``overlap``. A word too
long for any chunk is cut by character count instead. The text must be
cleaned first (single spaces, no line breaks): the space is the only separator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.functions.text import clean_text

# Default chunk length and overlap, in characters.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50

# Characters a worker holds cut as Python strings at a time, unless one text is longer.
HELD_CHARS = 1 << 20


def _word_packed(text: str, lo: int, hi: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Character intervals packing the words of ``text[lo:hi]``, all shorter than ``size``."""
    while lo < hi:
        if hi - lo <= size:
            yield lo, hi
            return
        end = text.rfind(" ", lo + 1, lo + size + 1)
        yield lo, end
        following = text.find(" ", end + 1, hi)
        next_end = hi if following < 0 else following
        # The kept tail obeys the overlap and leaves room for the next word.
        earliest = max(end - overlap, next_end - size, lo + 1)
        kept = text.find(" ", earliest, end)
        lo = end if kept < 0 else kept


def _by_characters(lo: int, hi: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Fixed windows over a word too long to pack."""
    while hi - lo > size:
        yield lo, lo + size
        lo += size - overlap
    yield lo, hi


def _intervals(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    start = 0
    for word in re.finditer(r"[^ ]{%d,}" % max(size - 1, 1), text):
        piece = max(word.start() - 1, 0)  # a word owns the space before it
        if word.end() - piece < size:
            continue
        yield from _word_packed(text, start, piece, size, overlap)
        yield from _by_characters(piece, word.end(), size, overlap)
        start = word.end()
    yield from _word_packed(text, start, len(text), size, overlap)


def split_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of one cleaned text; none for an empty one."""
    pieces = (text[lo:hi].strip(" ") for lo, hi in _intervals(text or "", size, overlap))
    return [piece for piece in pieces if piece]


def chunks(cleaned: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``ARRAY<STRING>`` of the chunks of a cleaned text column."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")

    kind = pa.list_(pa.string())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows, held = [], 0
            for text in texts:
                text = text.as_py()
                rows.append(split_text(text, size, overlap))
                held += len(text or "")
                if held > HELD_CHARS:
                    yield pa.array(rows, kind)
                    rows, held = [], 0
            yield pa.array(rows, kind)

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(cleaned)


def chunk_documents(
    documents: DataFrame,
    *id_cols: str,
    text_col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Clean, cut and explode: one row per chunk, numbered within its document.

    Documents without text leave no row.
    """
    pieces = chunks(clean_text(F.col(text_col)), size, overlap)
    return documents.select(
        *id_cols, F.posexplode(pieces).alias("chunk_no", "chunk_text")
    ).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))
