"""Encoding text columns as vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.operators.distinct import per_distinct
from tidewell.operators.models import once_per_worker
from tidewell.workspace import Workspace

# Fixed value: the dimension of the vectors unless an encoder says otherwise.
EMBEDDING_DIM = 384

# Texts whose words are counted at a time: their counts stay in a core's cache.
_COUNTED_ROWS = 256
# Texts a worker encodes at a time, so that its memory is that of their vectors alone.
_ENCODED_ROWS = 4096


class Encoder(Protocol):
    """Anything that turns texts into one vector each."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """The offline default: word counts hashed into ``dim`` buckets, unit length.

    It measures shared words, not meaning. A word's bucket is the first eight
    hex digits of its MD5, modulo ``dim``.
    """

    _MOST_KNOWN = 200_000

    def __init__(self, dim: int = EMBEDDING_DIM) -> None:
        self.dim = dim
        self._known: dict[str, int] = {"": -1}

    def bucket(self, word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode("utf-8")).digest()[:4], "big") % self.dim

    def _buckets(self, vocabulary: list[str]) -> list[int]:
        """The words' buckets; the first words met, most of them frequent, stay known."""
        found = list(map(self._known.get, vocabulary))
        for at, bucket in enumerate(found):
            if bucket is None:
                found[at] = bucket = self.bucket(vocabulary[at])
                if len(self._known) < self._MOST_KNOWN:
                    self._known[vocabulary[at]] = bucket
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Place 0 of a row is that of nothing between two spaces, and is left out.
        column = np.array(self._buckets(vocabulary), np.int64)[coded.indices.to_numpy(zero_copy_only=False)] + 1
        lengths = pc.list_value_length(words).to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        vectors = np.empty((len(texts), self.dim), np.float32)
        for lo in range(0, len(texts), _COUNTED_ROWS):
            hi = min(lo + _COUNTED_ROWS, len(texts))
            row = np.repeat(np.arange(hi - lo) * (self.dim + 1), lengths[lo:hi])
            places = (hi - lo) * (self.dim + 1)
            counts = np.bincount(row + column[ends[lo] : ends[hi]], minlength=places)
            counts = counts.reshape(hi - lo, self.dim + 1)[:, 1:].astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            vectors[lo:hi] = counts / np.where(norms == 0, 1.0, norms)
        return vectors


def vector_array(matrix: np.ndarray) -> pa.ListArray:
    """Arrow list column over a row-major matrix, without copying the values."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    values = np.ascontiguousarray(matrix, dtype=np.float32).reshape(-1)
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def packed_array(matrix: np.ndarray) -> pa.Array:
    """Arrow binary column of the rows' components, four little-endian bytes each."""
    rows, dim = matrix.shape
    ends = np.arange(rows + 1, dtype=np.int32) * (4 * dim)
    data = np.ascontiguousarray(matrix, dtype="<f4").reshape(-1)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked_array(column: pa.Array) -> pa.Array:
    """The vectors of ``packed_array`` as a list column; nulls stay."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy())])
    data = b"" if column.null_count == len(column) else _bytes_of(column)
    values = np.frombuffer(data, "<f4").astype(np.float32, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), pa.array(values), mask=column.is_null())


def _bytes_of(column: pa.Array) -> memoryview:
    """The bytes of all values, one after the other."""
    known = column.drop_null()
    places = np.frombuffer(known.buffers()[1], np.int64 if pa.types.is_large_binary(known.type) else np.int32)
    first, last = places[known.offset], places[known.offset + len(known)]
    return memoryview(known.buffers()[2])[first:last] if last > first else memoryview(b"")


def embedding(text: Column, encoder: Callable[[], Encoder] = HashedWords) -> Column:
    """``ARRAY<FLOAT>`` vectors of a text column.

    ``encoder`` makes the encoder inside the task, once per worker process. Equal texts of a
    batch are encoded once.
    """
    return _encoded(text, encoder, vector_array, pa.list_(pa.float32()), T.ArrayType(T.FloatType()))


def packed_embedding(text: Column, encoder: Callable[[], Encoder] = HashedWords) -> Column:
    """The same vectors as ``BINARY``, for tables that are written and copied more than read.

    A value of an array is written and read by itself, a packed vector as one value.
    """
    return _encoded(text, encoder, packed_array, pa.binary(), T.BinaryType())


def unpacked(packed: Column) -> Column:
    """``ARRAY<FLOAT>`` vectors of packed ones."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield unpacked_array(batch)

    return F.arrow_udf(run, T.ArrayType(T.FloatType()))(packed)


def _encoded(
    text: Column,
    encoder: Callable[[], Encoder],
    form: Callable[[np.ndarray], pa.Array],
    stored: pa.DataType,
    kind: T.DataType,
) -> Column:
    load = once_per_worker(encoder)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            coded = batch.fill_null("").dictionary_encode()
            rows = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(rows) < len(batch):
                # Copies are given out from the vectors of all different texts.
                vectors = np.concatenate([encoded(model, rows, lo) for lo in range(0, len(rows), _ENCODED_ROWS)])
                for lo in range(0, len(batch), _ENCODED_ROWS):
                    yield form(vectors[coded.indices[lo : lo + _ENCODED_ROWS].to_numpy()])
            elif rows:
                for lo in range(0, len(rows), _ENCODED_ROWS):
                    yield form(encoded(model, rows, lo))
            else:
                yield pa.array([], stored)

    def encoded(model: Encoder, rows: list[str], lo: int) -> np.ndarray:
        return np.asarray(model.encode(rows[lo : lo + _ENCODED_ROWS]), dtype=np.float32)

    return F.arrow_udf(run, kind)(text)


def embed(
    df: DataFrame,
    text_col: str,
    encoder: Callable[[], Encoder] = HashedWords,
    output: str = "embedding",
) -> DataFrame:
    return df.withColumn(output, embedding(F.col(text_col), encoder))


def embed_distinct(
    df: DataFrame,
    text_col: str,
    workspace: Workspace,
    encoder: Callable[[], Encoder] = HashedWords,
    output: str = "embedding",
) -> DataFrame:
    """As ``embed``, with each distinct text of the whole table encoded once.

    See ``per_distinct`` for when that is worth it.
    """
    return per_distinct(df, text_col, workspace, lambda text: embedding(text, encoder), output)
