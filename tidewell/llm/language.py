"""Language identification by error-correcting output codes.

Every language has a codeword; one logistic classifier over hashed byte n-grams
predicts each bit. A text gets the language whose codeword is nearest by the
bits' exponential losses, each weighted by how well that bit did on the training
sample, and is flagged as ambiguous when the runner-up is almost as near.

Edge cases: null texts and texts without any letter are ``und`` with score 0;
ties go to the first language by name; without any usable language all texts are
``und``; with one language every text with a letter is of it; texts of any length are read
whole; repeated rows are predicted alike; an empty table gives no rows; columns other than
doc_id, text and lang are not read. The training matrix on the driver has 400 texts of
each language at most, so it grows with the number of languages.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewell.llm.common import (
    fit_logistic,
    is_held_out,
    row_blocks,
    sampled_keys,
    text_bytes,
)

# Fixed values of the query: held-out fold, and the name of no language.
FOLDS, FOLD, UNKNOWN = 4, 2, "und"

# The training sample: documents of each language, and the longest one taken.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_BYTES = 16_384

BUCKETS = 4096
GRAMS = (1, 2, 3)
AMBIGUOUS_BELOW = 0.6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codewords(classes: int) -> np.ndarray:
    """(classes, bits) of -1 and 1.

    Up to five classes have all 2^(k-1) - 1 splits, no two alike or opposite. For more,
    random splits are drawn from a fixed seed and the set with the greatest least distance
    kept; some of these may be alike, which weighs that split double.
    """
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = [bits for bits in product((1, -1), repeat=classes) if bits[0] == 1]
        return np.array([bits for bits in splits if -1 in bits], float).T
    bits = int(np.ceil(10 * np.log2(classes)))
    rng, best, found = np.random.default_rng(classes), -1, None
    for _ in range(200):
        draw = rng.choice((-1.0, 1.0), (classes, bits))
        if np.any(np.abs(draw.sum(axis=0)) == classes):
            continue
        least = ((bits - draw @ draw.T) / 2 + np.eye(classes) * bits).min()
        if least > best:
            best, found = least, draw
    return found


def gram_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, buckets) square roots of the shares of hashed byte n-grams, unit length.

    ASCII capitals count as small letters. N-grams never cross texts.
    """
    texts = len(bounds) - 1
    small = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    counts = np.zeros((texts, BUCKETS), np.float32)
    wide = small.astype(np.uint64)
    code = np.zeros(len(small), np.uint64)
    for length in range(1, max(GRAMS) + 1):
        code = code[: len(wide) - length + 1] if length <= len(wide) else code[:0]
        if not len(code):
            break
        code = (code << np.uint64(8)) | wide[length - 1 :]
        if length not in GRAMS:
            continue
        key = code + np.uint64(length << 40)
        bucket = ((key * _MIX) >> np.uint64(64 - 12)).astype(np.int64)
        for row in range(texts):
            a, b = bounds[row], bounds[row + 1] - length + 1
            if b > a:
                counts[row] += np.bincount(bucket[a:b], minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)


@dataclass
class CodeModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and whether that is ambiguous."""
        margins = np.clip(features @ self.weights + self.bias, -4, 4)
        losses = np.exp(-margins[:, None, :] * self.codes) * self.trust
        total = losses.sum(axis=2) / self.trust.sum()
        likely = np.exp(total.min(axis=1, keepdims=True) - total)
        likely /= likely.sum(axis=1, keepdims=True)
        best = total.argmin(axis=1)
        score = likely[np.arange(len(best)), best]
        return best, score, score < AMBIGUOUS_BELOW


def train_codes(texts: list[str], names: list[str]) -> CodeModel:
    """One classifier for each bit, classes weighing alike; trust is the bit's margin of success."""
    languages = sorted(set(names))
    codes = codewords(len(languages))
    if len(languages) < 2:
        return CodeModel(languages, codes, np.zeros((BUCKETS, 1)), np.ones(1), np.ones(1))
    features = np.concatenate(
        [
            gram_features(data, bounds)
            for at in range(0, len(texts), 64)
            for data, bounds in [text_bytes(pa.array(texts[at : at + 64], pa.string()))]
        ]
    )
    index = {name: i for i, name in enumerate(languages)}
    row = np.array([index[name] for name in names])
    wanted = codes[row]
    size = np.bincount(row, minlength=len(languages))
    weight = np.repeat((1 / size[row])[:, None], codes.shape[1], axis=1)
    weights, bias = fit_logistic(features, (wanted + 1) / 2, weight, 1e-6, 150)
    right = ((features @ weights + bias) * wanted > 0).mean(axis=0)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.1)
    return CodeModel(languages, codes, weights.astype(np.float32), bias.astype(np.float32), trust)


def fit_language(docs: DataFrame) -> CodeModel:
    """Train on a bounded sample of texts of known language outside the held-out fold."""
    known = docs.select("doc_id", "lang").where(
        F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~is_held_out("doc_id", FOLDS, FOLD)
    )
    keys = sampled_keys(known, "doc_id", "lang", SAMPLE_PER_LANGUAGE)
    languages = max(1, known.select("lang").distinct().count())
    rows = (
        docs.select("doc_id", "text", "lang")
        .where(F.col("lang").isNotNull() & F.octet_length("text").between(1, SAMPLE_BYTES))
        .join(F.broadcast(keys.select("doc_id").distinct()), "doc_id")
        .limit(2 * SAMPLE_PER_LANGUAGE * languages)
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("text", "ascending")])
    )
    return train_codes(rows["text"].to_pylist(), rows["lang"].to_pylist())


def _has_letter(data: np.ndarray) -> bool:
    folded = data | np.uint8(32)
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    if not (data >= 128).any():
        return False
    return any(map(str.isalpha, data.tobytes().decode("utf-8", "ignore")))


def identify_language(docs: DataFrame, model: CodeModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    model = model or fit_language(docs)
    kind = T.StructType(
        [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )

    def run(texts: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        names, scores, doubts = [], [], []
        for first, last in row_blocks(bounds):
            part = data[bounds[first] : bounds[last]]
            own = bounds[first : last + 1] - bounds[first]
            spoken = [_has_letter(part[a:b]) for a, b in zip(own[:-1], own[1:])]
            for at in range(0, last - first, 256):
                end = min(at + 256, last - first)
                inner = own[at : end + 1]
                best, score, doubt = model.decode(
                    gram_features(part[inner[0] : inner[-1]], inner - inner[0])
                )
                for i in range(end - at):
                    real = spoken[at + i] and bool(model.languages)
                    names.append(model.languages[best[i]] if real else UNKNOWN)
                    scores.append(float(score[i]) if real else 0.0)
                    doubts.append(bool(doubt[i]) if real else True)
        return pa.StructArray.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(doubts, pa.bool_()),
            ],
            ["lang_pred", "score", "ambiguous"],
        )

    found = F.arrow_udf(run, kind)(F.col("text"))
    return docs.select(
        "doc_id", is_held_out("doc_id", FOLDS, FOLD).alias("held_out"), found.alias("found")
    ).select("doc_id", "held_out", "found.*")
