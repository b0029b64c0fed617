"""Toxicity by weak supervision.

Terms (words and word beginnings) that stand out in the labelled training sample
form lexicons. Lexicon voters hold counts of such terms against a bound; pattern voters
look for forms: an insult directed at the reader, repeated marks, shouted words, letters
drawn out, letters hidden behind digits or signs. A generative label model, fitted by
expectation maximisation to the voters' answers on a sample whose labels it never sees,
estimates how each voter answers in either class and how far voters repeat each other within
the classes; a voter that repeats others counts for less. A linear classifier is trained on
the posterior labels, set to the labels' true shares on labelled texts kept aside, and
scores every whole text.

Edge cases: null and empty texts score by the classifier's bias; repeated rows score
alike; texts of any length are scored whole, block by block; a score equal to the threshold is
class 1; without labels of both classes every score is the labels' share of class 1, 0.5
without any; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.llm.common import (
    fit_logistic,
    is_held_out,
    known_labels,
    labelled_texts,
    row_blocks,
    text_bytes,
)

# Fixed values of the query: held-out fold, threshold of the predicted class.
FOLDS, FOLD, THRESHOLD = 5, 0, 0.5

# The training sample: labelled documents of each class, unlabelled ones, the longest taken.
SAMPLE_PER_CLASS = {0: 2400, 1: 900}
SAMPLE_UNLABELLED = 900
SAMPLE_BYTES = 16_384

# Lengths in bytes of the word beginnings that are terms, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
KINDS = 1 + len(BEGINNINGS)
# Evidence (log-likelihood ratio) a term needs; the share of toxic documents among those
# that have it, classes weighing alike, that makes it strong; the most terms of a kind.
EVIDENCE, STRONG, MOST_TERMS = 10.0, 0.95, 400

# The patterns that vote, on texts as they are written. A word of the first kind
# must also stand near an insult, that is, a strong term of the lexicon.
ADDRESS = re.compile(r"\b(?:you(?:'re| are)?|your|u|tu|vous|du|ihr|eres|usted|t[uú])\b", re.IGNORECASE)
PATTERNS = (
    re.compile(r"[!?]{2,}"),
    re.compile(r"\b[A-ZÀ-ÞŸ]{4,}\b"),
    re.compile(r"([A-Za-zÀ-ÿ])\1{3,}"),
    re.compile(r"[A-Za-z](?:[0-9@$*!]+[A-Za-z]+){1,}"),
)
# Words between an address and an insult at most.
NEAR = 4

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def folded(data: np.ndarray) -> np.ndarray:
    """Small letters for the capitals of ASCII and of the two-byte Latin-1 letters."""
    small = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    return small | (capital.astype(np.uint8) << 5)


def term_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, key) of every term of every word; kind 0 is the whole word.

    A word is a run of letters: a-z in either case and all bytes beyond ASCII.
    A whole word's key mixes its first and last eight bytes and its length.
    """
    small = folded(data)
    letter = ((small >= 97) & (small <= 122)) | (small >= 128)
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    fresh[cut] = letter[cut]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
    stop = np.append(np.flatnonzero(~letter), len(data))
    ends = np.minimum(stop[np.searchsorted(stop, starts)], np.append(starts[1:], len(data)))
    length = ends - starts
    row = np.searchsorted(bounds, starts, side="right") - 1
    padded = np.concatenate([np.zeros(8, np.uint8), small, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(
        padded.view(), (len(padded) - 7, 8), (1, 1)
    )
    head = words[starts + 8].copy().view("<u8").ravel()
    tail = words[ends].copy().view("<u8").ravel()
    short = np.minimum(length, 8)
    first = head & _LOW_BYTES[short]
    whole = (first * _A) ^ ((tail >> ((8 - short).astype(np.uint64) * np.uint64(8))) * _B)
    whole = (whole + length.astype(np.uint64)) * _A
    rows, kinds, keys = [row], [np.zeros(len(row), np.int8)], [whole]
    for kind, size in enumerate(BEGINNINGS, 1):
        fit = length >= size
        rows.append(row[fit])
        kinds.append(np.full(int(fit.sum()), kind, np.int8))
        keys.append(((head[fit] & _LOW_BYTES[size]) ^ np.uint64(size)) * _B)
    return np.concatenate(rows), np.concatenate(kinds), np.concatenate(keys)


@dataclass
class Lexicon:
    """Sorted keys of the terms, their kinds and toxic shares, and a filter for quick misses."""

    keys: np.ndarray
    kinds: np.ndarray
    share: np.ndarray

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def find(self, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of every occurrence of a term."""
        maybe = np.flatnonzero(self.filter[(keys >> np.uint64(48)).astype(np.int64)])
        if not len(self.keys) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, keys[maybe]).clip(max=len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        return rows[maybe[hit]], at[hit]


def mine_terms(rows: np.ndarray, keys: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys found in clearly more documents of class 1 than of class 0, and their share of class 1.

    Clearly: by the likelihood ratio against the share in the sample. The share
    returned weighs the classes alike.
    """
    order = np.lexsort((rows, keys))
    rows, keys = rows[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    rows, keys = rows[fresh], keys[fresh]
    if not len(keys):
        return keys, np.zeros(0)
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ones = np.add.reduceat(y[rows], begins)
    total = np.diff(np.append(begins, len(keys)))
    share = y.mean()
    p = ones / total
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * total * (
            np.where(p > 0, p * np.log(p / share), 0)
            + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0)
        )
    good = np.flatnonzero((p > share) & (ratio >= EVIDENCE))
    good = good[np.argsort(-ratio[good], kind="stable")][:MOST_TERMS]
    toxic, clean = (ones[good] + 0.1) / share, (total - ones)[good] + 0.1
    return keys[begins[good]], toxic / (toxic + clean / (1 - share))


def mine_lexicon(texts: list[str], y: np.ndarray) -> Lexicon:
    """The terms of every kind, mined kind by kind to keep memory low."""
    found = [_terms_of(texts[at : at + 200], at) for at in range(0, len(texts), 200)]
    keys, kinds, shares = [], [], []
    for kind in range(KINDS):
        rows = np.concatenate([r[k == kind] for r, k, _ in found])
        mined, share = mine_terms(rows, np.concatenate([x[k == kind] for _, k, x in found]), y)
        keys.append(mined)
        kinds.append(np.full(len(mined), kind, np.int8))
        shares.append(share)
    joined, first = np.unique(np.concatenate(keys), return_index=True)
    return Lexicon(joined, np.concatenate(kinds)[first], np.concatenate(shares)[first])


def votes(rows: np.ndarray, terms: np.ndarray, lexicon: Lexicon, n: int) -> np.ndarray:
    """(documents, voters) of 1 (toxic), -1 (clean) and 0 (no answer)."""
    strong = lexicon.share[terms] >= STRONG
    by_kind = [(lexicon.kinds[terms] == kind) & strong for kind in range(KINDS)]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(rows[mask], minlength=n)

    distinct = np.zeros((n, max(1, len(lexicon.keys))), bool)
    distinct[rows[strong], terms[strong]] = True
    different = distinct.sum(axis=1)
    fires = [count(mask) > 0 for mask in by_kind]
    fires += [count(~strong) > 0, count(~strong) > 2, different > 1, different > 3, count(strong) > 2]
    answers = np.stack(fires, axis=1).astype(np.int8)
    nothing = (different == 0)[:, None]
    little = (different < 2)[:, None]
    return np.concatenate([answers, -nothing.astype(np.int8), -little.astype(np.int8)], axis=1)


def pattern_votes(texts: list[str], insults: set[str]) -> np.ndarray:
    """(documents, patterns): 1 where an insult follows an address soon, or a pattern is found."""
    answers = np.zeros((len(texts), 1 + len(PATTERNS)), np.int8)
    for row, text in enumerate(texts):
        if not insults.isdisjoint(word.strip(".,;:!?") for word in text.lower().split()):
            for match in ADDRESS.finditer(text):
                after = text[match.end() : match.end() + 40 * NEAR].lower().split()[:NEAR]
                if not insults.isdisjoint(word.strip(".,;:!?") for word in after):
                    answers[row, 0] = 1
                    break
        for column, pattern in enumerate(PATTERNS, 1):
            answers[row, column] = pattern.search(text) is not None
    return answers


@dataclass
class LabelModel:
    """Class shares, answer rates (2 classes, voters, 3 answers) and each voter's own weight."""

    share: np.ndarray
    rates: np.ndarray
    own: np.ndarray

    def posterior(self, answers: np.ndarray) -> np.ndarray:
        picked = np.log(self.rates[:, np.arange(answers.shape[1]), answers + 1])
        score = np.log(self.share)[:, None] + (picked * self.own).sum(axis=2)
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))


def fit_label_model(answers: np.ndarray, rounds: int = 40) -> LabelModel:
    """Expectation maximisation from the majority of answers, without any label.

    After each round the voters' answers are correlated within the classes; a
    voter's weight is one over the number of voters it amounts to a copy of.
    """
    n, k = answers.shape
    net = answers.sum(axis=1)
    y = np.where(net > 0, 0.9, np.where(net < 0, 0.05, 0.3))
    model = LabelModel(np.array([0.5, 0.5]), np.full((2, k, 3), 1 / 3), np.ones(k))
    for _ in range(rounds):
        share = np.array([(1 - y).mean(), y.mean()]).clip(0.01)
        rates = np.empty((2, k, 3))
        within = np.zeros((k, k))
        for c, weight in enumerate((1 - y, y)):
            for answer in (-1, 0, 1):
                rates[c, :, answer + 1] = weight @ (answers == answer) + 0.5
            rates[c] /= rates[c].sum(axis=1, keepdims=True)
            centred = answers - (weight @ answers) / max(weight.sum(), 1e-9)
            within += (centred * weight[:, None]).T @ centred
        spread = np.sqrt(np.diag(within)).clip(1e-9)
        alike = np.abs(within / spread / spread[:, None])
        np.fill_diagonal(alike, 0)
        model = LabelModel(share / share.sum(), rates, 1 / (1 + alike.sum(axis=1)))
        y = model.posterior(answers)
    return model


def features(rows: np.ndarray, terms: np.ndarray, n: int, lexicon: Lexicon) -> np.ndarray:
    """(documents, terms + 2): presence of each term, and how many there are, in all and strong."""
    x = np.zeros((n, len(lexicon.keys) + 2), np.float32)
    x[rows, terms] = 1
    strong = lexicon.share >= STRONG
    x[:, -2] = np.log1p(x[:, :-2].sum(axis=1))
    x[:, -1] = np.log1p(x[:, :-2][:, strong].sum(axis=1))
    return x


@dataclass
class Linear:
    """The classifier, and the line that turns its answer and the text's length into log-odds."""

    lexicon: Lexicon
    weight: np.ndarray
    bias: float
    line: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def inputs(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classifier's answers, and logarithms of the numbers of words."""
        n = len(bounds) - 1
        rows, kinds, keys = term_keys(data, bounds)
        words = np.log1p(np.bincount(rows[kinds == 0], minlength=n))
        rows, terms = self.lexicon.find(rows, keys)
        pairs = np.unique(rows * len(self.weight) + terms) if len(rows) else np.zeros(0, np.int64)
        rows, terms = np.divmod(pairs, len(self.weight))
        z = np.full(n, self.bias)
        z += np.bincount(rows, self.weight[terms], minlength=n)
        strong = (self.lexicon.share >= STRONG)[terms]
        z += self.weight[-2] * np.log1p(np.bincount(rows, minlength=n))
        z += self.weight[-1] * np.log1p(np.bincount(rows[strong], minlength=n))
        return z, words

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z, words = self.inputs(data, bounds)
        odds = self.line[0] * z + self.line[1] * words + self.line[2]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _terms_of(texts: list[str], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, kinds, keys = term_keys(*text_bytes(pa.array(texts, pa.large_string())))
    return (rows + first).astype(np.int32), kinds, keys


def calibrated(model: Linear, texts: list[str], y: np.ndarray, share: float) -> Linear:
    """The model with its line fitted to labels it has not seen, classes in their true shares."""
    if not len(y) or not 0 < y.mean() < 1:
        return model
    parts = [
        model.inputs(*text_bytes(pa.array(texts[at : at + 200], pa.large_string())))
        for at in range(0, len(texts), 200)
    ]
    x = np.stack([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])], 1)
    middle, spread = x.mean(axis=0), x.std(axis=0).clip(1e-6)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))[:, None]
    slope, start = fit_logistic((x - middle) / spread, y[:, None], weight, 1e-4, 1000)
    slope = slope[:, 0] / spread
    return replace(
        model, line=(float(slope[0]), float(slope[1]), float(start[0] - slope @ middle))
    )


def one_class_odds(share: float | None) -> float:
    """Log-odds of a share, within what a score can show."""
    share = min(max(0.5 if share is None else share, 1e-12), 1 - 1e-12)
    return float(np.log(share / (1 - share)))


def strong_words(lexicon: Lexicon, texts: list[str]) -> set[str]:
    """The whole words, in small letters, that are strong terms, as the texts spell them."""
    whole = Lexicon(*(part[(lexicon.kinds == 0) & (lexicon.share >= STRONG)] for part in (lexicon.keys, lexicon.kinds, lexicon.share)))
    words = sorted({word.strip(".,;:!?") for text in texts for word in text.lower().split()} - {""})
    rows, kinds, keys = term_keys(*text_bytes(pa.array(words, pa.large_string())))
    found, _ = whole.find(rows[kinds == 0], keys[kinds == 0])
    return {words[i] for i in found}


def train_toxicity(
    texts: list[str], labels: np.ndarray, more: list[str], share: float | None = None
) -> Linear:
    """Lexicons from ``texts`` and ``labels``; label model and classifier from their votes and ``more``.

    Every third labelled text is kept from all that and only calibrates the
    result; ``share`` is the true share of class 1.
    """
    nothing = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0))
    if not len(labels) or not 0 < labels.mean() < 1:
        known = labels.mean() if len(labels) else 0.5
        return Linear(nothing, np.zeros(2), one_class_odds(known if share is None else share))
    share = labels.mean() if share is None else share
    kept = np.arange(len(texts)) % 3 == 2
    last, marks = [t for t, k in zip(texts, kept) if k], labels[kept]
    texts, labels = [t for t, k in zip(texts, kept) if not k], labels[~kept]
    if not 0 < labels.mean() < 1:
        return Linear(nothing, np.zeros(2), one_class_odds(share))
    lexicon = mine_lexicon(texts, labels)
    everything = texts + more
    rows, terms = [], []
    for at in range(0, len(everything), 200):
        own, _, keys = _terms_of(everything[at : at + 200], at)
        own, term = lexicon.find(own, keys)
        rows.append(own)
        terms.append(term)
    row, term, n = np.concatenate(rows), np.concatenate(terms), len(everything)
    answers = np.concatenate(
        [votes(row, term, lexicon, n), pattern_votes(everything, strong_words(lexicon, texts))], axis=1
    )
    posterior = fit_label_model(answers).posterior(answers)
    x = features(row, term, n, lexicon)
    weight, bias = fit_logistic(x, posterior[:, None], np.ones((n, 1)), 1e-4, 300)
    return calibrated(Linear(lexicon, weight[:, 0], float(bias[0])), last, marks, share)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Linear:
    """Train on bounded samples of documents outside the held-out fold."""
    texts, marks = labelled_texts(
        docs, labels, "toxic", SAMPLE_PER_CLASS, SAMPLE_BYTES, FOLDS, FOLD
    )
    usable = docs.select("doc_id", "text").where(
        F.octet_length("text").between(1, SAMPLE_BYTES) & ~is_held_out("doc_id", FOLDS, FOLD)
    )
    count = usable.count()
    share = min(1.0, SAMPLE_UNLABELLED / max(count, 1))
    unit = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    more = usable.where(unit < share).limit(2 * SAMPLE_UNLABELLED).toArrow()
    share = known_labels(labels, "toxic", FOLDS, FOLD).agg(F.avg("label")).first()[0]
    return train_toxicity(texts, marks, sorted(more["text"].to_pylist()), share)


def toxicity_score(model: Linear, text: Column) -> Column:
    """The probability of class 1 of each whole text, in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        scores = [
            model.score(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            for a, b in row_blocks(bounds)
        ]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return F.arrow_udf(run, T.DoubleType())(text)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit_toxicity(docs, labels)
    return docs.select(
        "doc_id",
        is_held_out("doc_id", FOLDS, FOLD).alias("held_out"),
        toxicity_score(model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
