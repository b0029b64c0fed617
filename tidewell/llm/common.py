"""What the operators of this subpackage share: byte views of text columns, bounded samples."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.workspace import Workspace

# Text bytes a task holds in NumPy form at a time, unless one text is longer.
BLOCK_BYTES = 1 << 18


_scopes: list[list[Workspace]] = []


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Clears, at its end, every workspace that ``scratch`` gave out in it.

    For results that have been written elsewhere by then.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for workspace in _scopes.pop():
            workspace.clear()


def scratch(spark: SparkSession, label: str) -> Workspace:
    """A workspace under the cluster's shared folder, removed when the driver's Python ends.

    Results read from it lazily, so it can't go earlier by itself, but in a ``scratch_scope``.
    """
    workspace = Workspace(spark, label)
    if _scopes:
        _scopes[-1].append(workspace)

    def clear() -> None:
        with contextlib.suppress(Exception):
            workspace.clear()

    atexit.register(clear)
    return workspace


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins and ends.

    A null counts as an empty text. The bytes are a view, not a copy.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if large else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def row_blocks(bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, at least one row each."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def give_back() -> None:
    """Return a worker's unused memory to the system.

    Arrow's pool and the C library keep what they freed, some 140 MB a worker after batches of
    texts, and a reused worker would keep it through every later stage.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that returns unused memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def by_blocks(
    function: Callable[[pa.Array], pa.Array], texts: pa.Array, kind: pa.DataType
) -> pa.Array:
    """``function`` of all texts, a block at a time, so few are Python strings at once."""
    parts = [function(texts.slice(a, b - a)) for a, b in row_blocks(text_bytes(texts)[1])]
    whole = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    give_back()
    return whole


def is_held_out(key: str, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the key's decimal text leaves ``fold`` modulo ``folds``."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def _share(key: str) -> Column:
    """A fixed number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(F.lit(29), F.col(key)), F.lit(1 << 30)) / float(1 << 30)


def sampled_keys(
    rows: DataFrame, key: str, group: str, per_group: int | dict[int, int]
) -> DataFrame:
    """(key, group) of about ``per_group`` rows of each group, picked by the key's hash.

    ``rows`` has one group for a key. Groups are few (classes, languages); the
    whole is cut at 1.5 times the expected size, a bound chance won't reach.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return rows.select(key, group)
    each = per_group if isinstance(per_group, dict) else dict.fromkeys(counts, per_group)
    wanted = F.lit(0.0)
    for value, count in sorted(counts.items(), key=repr):
        wanted = F.when(F.col(group) == value, each[value] / count).otherwise(wanted)
    picked = rows.select(key, group).where(_share(key) < wanted)
    return picked.limit(int(1.5 * sum(each[value] for value in counts)) + 1)


def known_labels(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold; a key's highest label counts, nulls don't."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(~is_held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: dict[int, int],
    max_bytes: int,
    folds: int,
    fold: int,
) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled documents outside the held-out fold.

    About ``per_class`` documents of each class, none longer than
    ``max_bytes``; so the driver never gets more than their product. Rows
    without key, text or label are left out.
    """
    known = known_labels(labels, label, folds, fold)
    keys = sampled_keys(known, "doc_id", "label", per_class)
    rows = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text").between(1, max_bytes))
        .join(F.broadcast(keys), "doc_id")
        .limit(2 * sum(per_class.values()))
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("text", "ascending")])
    )
    return rows["text"].to_pylist(), rows["label"].to_numpy().astype(np.float64)


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 200
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic model for each column of ``y`` (soft labels).

    Full-batch Adam; ``x`` is (rows, features), ``weight`` (rows, columns).
    """
    n, k = x.shape[1], y.shape[1]
    w, b = np.zeros((n, k)), np.zeros(k)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    scale = weight.sum(axis=0).clip(1e-9)
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -30, 30))) - y) * weight / scale
        for value, slope, first, second in (
            (w, x.T @ error.astype(x.dtype) + ridge * w, moments[0], moments[1]),
            (b, error.sum(axis=0), moments[2], moments[3]),
        ):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            rate = 0.05 / (1 - 0.9**step) / np.sqrt(1 / (1 - 0.99**step))
            value -= rate * first / (np.sqrt(second) + 1e-8)
    return w, b
