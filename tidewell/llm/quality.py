"""Document quality by a byte-level convolutional network.

A document's bytes go through learned filters over overlapping chunks, the
strongest answer of each filter over the whole document is kept, and a logistic
layer combines these into one probability. Chunks overlap, so that no window is lost at
their edges: windows begin at every second byte and the last one ends with the text.
Nothing is cut off, however long the text.

Because a filter is linear in the embedded bytes, its answer is a sum of table
entries, one table for each place in the window: scoring multiplies nothing.

Edge cases: null and empty texts score as a text of padding alone; repeated rows
score alike; a score equal to the threshold is class 1; without usable labels of both
classes every score is the share of class 1 among the labels, or 0.5 without any; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.llm.common import give_back, is_held_out, known_labels, labelled_texts, text_bytes

# Fixed values of the query: held-out fold, threshold of the predicted class.
FOLDS, FOLD, THRESHOLD = 5, 0, 0.3

# The training sample: documents of each class, and the longest one taken.
SAMPLE_PER_CLASS = {0: 800, 1: 800}
SAMPLE_BYTES = 16_384

WIDTH, STRIDE, FILTERS, EMBEDDED = 8, 2, 20, 6
CHUNK = 16_384


@dataclass
class ByteNetwork:
    """Byte tables (width, 256, filters), filter biases, and the combining layer."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """The strongest answer of every filter anywhere in ``data``."""
        if len(data) < WIDTH + STRIDE:
            data = np.concatenate([data, np.zeros(WIDTH + STRIDE - len(data), np.uint8)])
        best = None
        last = len(data) - WIDTH
        for begin in range(0, last + 1, CHUNK):
            chunk = data[begin : begin + CHUNK + WIDTH - 1]
            answers = _convolve(self.tables, chunk).max(axis=0)
            best = answers if best is None else np.maximum(best, answers)
        # The window that ends with the text, which the stride may step over.
        best = np.maximum(best, _convolve(self.tables, data[last:]).max(axis=0))
        return np.maximum(best + self.bias, 0)

    def score(self, data: np.ndarray) -> float:
        z = float(self.pooled(data) @ self.out) + self.out_bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _convolve(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(windows, filters) answers of the windows that begin at multiples of the stride."""
    windows = (len(data) - WIDTH) // STRIDE + 1
    answers = tables[0].take(data[0 : windows * STRIDE : STRIDE], axis=0)
    for place in range(1, WIDTH):
        answers += tables[place].take(data[place : place + windows * STRIDE : STRIDE], axis=0)
    return answers


def train_network(
    texts: list[str],
    labels: np.ndarray,
    epochs: int = 24,
    seed: int = 17,
    true_share: float | None = None,
) -> ByteNetwork:
    """Fit embedding, filters and combining layer by Adam on cross-entropy.

    Only the window that won the pooling of a filter gets a gradient, so the
    backward step costs next to nothing. Classes weigh alike in training and the
    bias is then moved to their true shares: ``true_share`` is class 1's, or else the sample's.
    """
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        empty = np.zeros((WIDTH, 256, FILTERS), np.float32)
        z = 30.0 if share == 1 else -30.0 if len(labels) and share == 0 else 0.0
        return ByteNetwork(empty, np.zeros(FILTERS, np.float32), np.zeros(FILTERS), z)
    docs = []
    for text in texts:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        pad = max(0, WIDTH + STRIDE - len(data))
        docs.append(np.concatenate([data, np.zeros(pad, np.uint8)]) if pad else data)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDED)),
        "filter": rng.normal(0, 0.3, (WIDTH, EMBEDDED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.3, FILTERS),
        "out_bias": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            tables = (params["embed"] @ params["filter"]).astype(np.float32)
            windows = np.empty((len(batch), FILTERS, WIDTH), np.uint8)
            best = np.empty((len(batch), FILTERS))
            for row, doc in enumerate(batch):
                data = docs[doc]
                shift = int(rng.integers(STRIDE)) if len(data) > WIDTH + STRIDE else 0
                answers = _convolve(tables, data[shift:])
                winner = answers.argmax(axis=0)
                best[row] = answers[winner, np.arange(FILTERS)]
                windows[row] = data[(shift + winner * STRIDE)[:, None] + np.arange(WIDTH)]
            active = best + params["bias"] > 0
            hidden = np.where(active, best + params["bias"], 0)
            z = hidden @ params["out"] + params["out_bias"][0]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch]
            error /= len(batch)
            back = error[:, None] * params["out"] * active
            embedded = params["embed"][windows]
            slopes = {
                "filter": np.einsum("rf,rfpe->pef", back, embedded),
                "bias": back.sum(axis=0),
                "out": hidden.T @ error + 1e-4 * params["out"],
                "out_bias": np.array([error.sum()]),
                "embed": np.zeros_like(params["embed"]),
            }
            np.add.at(
                slopes["embed"],
                windows.ravel(),
                np.einsum("rf,pef->rfpe", back, params["filter"]).reshape(-1, EMBEDDED),
            )
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for name, slope in slopes.items():
                first[name] += 0.1 * (slope - first[name])
                second[name] += 0.001 * (slope * slope - second[name])
                grown = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                params[name] -= rate * first[name] / (1 - 0.9**step) / grown
    if true_share is None or not 0 < true_share < 1:
        true_share = share
    return ByteNetwork(
        (params["embed"] @ params["filter"]).astype(np.float32),
        params["bias"].astype(np.float32),
        params["out"],
        float(params["out_bias"][0]) + float(np.log(true_share / (1 - true_share))),
    )


def fit_quality(docs: DataFrame, labels: DataFrame) -> ByteNetwork:
    """Train on the bounded sample of labelled documents outside the held-out fold."""
    texts, marks = labelled_texts(
        docs, labels, "quality", SAMPLE_PER_CLASS, SAMPLE_BYTES, FOLDS, FOLD
    )
    share = known_labels(labels, "quality", FOLDS, FOLD).agg(F.avg("label")).first()[0]
    return train_network(texts, marks, true_share=share)


def quality_score(model: ByteNetwork, text: Column) -> Column:
    """The probability of class 1 of each whole text, in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        scores = [model.score(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        give_back()
        return pa.array(scores, pa.float64())

    return F.arrow_udf(run, T.DoubleType())(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit_quality(docs, labels)
    return docs.select(
        "doc_id",
        is_held_out("doc_id", FOLDS, FOLD).alias("held_out"),
        quality_score(model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
