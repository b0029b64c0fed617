"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

A passage of m bytes with at most k edits keeps at least m + 1 - q (k + 1) of its
q-grams, and their diagonals (place in the text less place in the passage) lie within
k of each other. So shared q-grams are counted in overlapping bands of diagonals, a
band is kept when its count reaches that bound, and only there is the passage aligned,
in the band, to find the stretch of text with the fewest edits.

Both sides are compared as UTF-8 bytes, with the capitals of ASCII and Latin-1 as small
letters and every run of white space as one space. The budget is a tenth of the passage, less for
passages of under 32 bytes so that the bound stays positive; under eight bytes only
exact copies count.

The passages go to the tasks in blocks of a bounded size, one pass over the documents
a block; documents are never shuffled.

Edge cases: null, empty and blank passages match nothing; null and empty texts hold
nothing; repeated passages and documents are reported each; where stretches of one
passage overlap in a text, the one with fewest edits, then the first, is reported; texts of
any length are searched whole; empty tables give no rows; columns other than the ids and
texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.llm.common import give_back, giving_back, row_blocks, text_bytes
from tidewell.llm.toxicity import folded

Q = 8
BUDGET = 0.1
# Bytes of passages that go to the tasks at a time.
BLOCK_OF_PASSAGES = 8 << 20
HITS = "doc_id long, item_id long, start long, end long, edits int"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = 32


def plain(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their bounds by text, and the place each byte had."""
    small = _PLAIN[folded(data)]
    keep = small != 32
    keep[1:] |= small[:-1] != 32
    inner = bounds[:-1][bounds[:-1] < len(data)]
    keep[inner] = True
    place = np.flatnonzero(keep)
    return small[place], np.searchsorted(place, bounds), place


def _grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(Q, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded.data, 0, (1,))


class Passages:
    """A block of benchmark passages, indexed by q-gram."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        for key, text in items:
            data, bounds = text_bytes(pa.array([text], pa.large_string()))
            kept = plain(data, bounds)[0].tobytes().strip()
            if kept:
                self.ids.append(key)
                self.texts.append(np.frombuffer(kept, np.uint8))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.minimum((self.size * BUDGET).astype(np.int64), self.size // Q - 1).clip(0)
        self.bound = self.size + 1 - Q * (self.budget + 1)
        self.short = np.flatnonzero(self.size < Q)
        grams, item, place = [], [], []
        for i, text in enumerate(self.texts):
            if len(text) >= Q:
                own = _grams(text)[: len(text) - Q + 1]
                grams.append(own)
                item.append(np.full(len(own), i))
                place.append(np.arange(len(own)))
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.item = np.concatenate(item)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        self.code, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.code)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * _MIX) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def bands(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(text, item, low diagonal) rows of the bands whose count reaches the bound.

        A band of item i covers 2 (k + 1) diagonals and begins at every (k + 1)-th.
        """
        if not len(self.code) or not len(data):
            return np.zeros((0, 3), np.int64)
        code = _grams(data)
        at = np.flatnonzero(self.filter[self._slot(code)])
        which = np.searchsorted(self.code, code[at]).clip(max=len(self.code) - 1)
        exact = self.code[which] == code[at]
        at, which = at[exact], which[exact]
        text = np.searchsorted(bounds, at, side="right") - 1
        inside = at + Q <= bounds[text + 1]
        at, which, text = at[inside], which[inside], text[inside]
        found = []
        for low in range(0, len(at), 1 << 15):  # a q-gram may be in many passages
            part = slice(low, low + (1 << 15))
            number = self.first[which[part] + 1] - self.first[which[part]]
            row = np.repeat(np.arange(len(number)), number)
            ends = np.cumsum(number)
            posting = np.arange(len(row)) + np.repeat(self.first[which[part]] - (ends - number), number)
            item = self.item[posting]
            diagonal = at[part][row] - self.place[posting] + self.size[item]
            pair = text[part][row] * len(self.ids) + item
            found.append(np.stack([pair, diagonal // (self.budget[item] + 1), self.place[posting]]))
        if not found:
            return np.zeros((0, 3), np.int64)
        pair, step, place = np.concatenate(found, axis=1)
        # Kept q-grams are at different places of the passage: repeats don't count.
        order = np.lexsort((place, step, pair))
        pair, step, place = pair[order], step[order], place[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (np.diff(pair) != 0) | (np.diff(step) != 0) | (np.diff(place) != 0)
        span = int(step.max(initial=0)) + 2
        key, count = np.unique((pair * span + step)[fresh], return_counts=True)
        # A band is a step of diagonals and the next one.
        below = np.searchsorted(key, key - 1).clip(max=len(key) - 1)
        with_below = count + np.where(key[below] == key - 1, count[below], 0)
        good = with_below >= self.bound[(key // span) % len(self.ids)]
        # A band whose lower step is empty is covered as the lower step of its own.
        text, item = np.divmod(key[good] // span, len(self.ids))
        low = (key[good] % span - 1) * (self.budget[item] + 1) - self.size[item]
        return np.stack([text, item, low], axis=1)

    def align(self, data: np.ndarray, item: int, low: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best stretch of ``data`` in a band, if within the budget."""
        budget = int(self.budget[item])
        passage = self.texts[item]
        high = low + 3 * (budget + 1)
        last = _banded(passage, data, low - budget, high)
        edits = int(last.min())
        if edits > budget:
            return None
        end = int(last.argmin()) + low - budget + len(passage)
        back = data[max(0, end - len(passage) - budget - 1) : end][::-1]
        lengths = _banded(passage[::-1], back, -budget - 1, budget + 1, anchored=True)
        start = end - (int(lengths.argmin()) - budget - 1 + len(passage))
        return start, end, edits


def _banded(
    passage: np.ndarray, data: np.ndarray, low: int, high: int, anchored: bool = False
) -> np.ndarray:
    """Fewest edits that end on each diagonal of the band, the passage used up.

    Diagonal d pairs passage place i with text place i + d. A stretch begins
    anywhere in the band, or at the text's first byte if ``anchored``.
    """
    width = high - low + 1
    far = len(passage) + width
    steps = np.arange(width)
    first = low + steps
    reach = (first >= 0) & (first <= len(data))
    best = np.where(reach, np.maximum(first, 0) if anchored else 0, far)
    padded = np.zeros(len(passage) + width + abs(low) + len(data) + 2, np.int16) - 1
    origin = max(0, -low) + 1
    padded[origin : origin + len(data)] = data
    for i, byte in enumerate(passage):
        begin = origin + i + low
        row = padded[begin : begin + width]
        if len(row) < width:
            row = np.concatenate([row, np.full(width - len(row), -1, np.int16)])
        new = best + (row != byte)
        new[row < 0] = far
        new[:-1] = np.minimum(new[:-1], best[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        ends = first + i + 1
        new[(ends < 0) | (ends > len(data))] = far
        best = new
    return best


def passage_hits(passages: Passages, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) in places of the given bytes, by text, item and start."""
    small, inner, place = plain(data, bounds)
    stretches: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for text, item, low in passages.bands(small, inner):
        a, b = inner[text], inner[text + 1]
        best = passages.align(small[a:b], int(item), int(low - a))
        if best:
            stretches.setdefault((int(text), int(item)), set()).add(best)
    for item in passages.short:
        wanted = passages.texts[item].tobytes()
        for text in range(len(bounds) - 1):
            whole = small[inner[text] : inner[text + 1]].tobytes()
            at = whole.find(wanted)
            while at >= 0:
                stretches.setdefault((text, int(item)), set()).add((at, at + len(wanted), 0))
                at = whole.find(wanted, at + 1)
    hits = []
    for (text, item), found in sorted(stretches.items()):
        chosen: list[tuple[int, int, int]] = []
        for start, end, edits in sorted(found, key=lambda s: (s[2], s[0])):
            if all(end <= a or b <= start for a, b, _ in chosen):
                chosen.append((start, end, edits))
        a = inner[text]
        for start, end, edits in sorted(chosen):
            begin = int(place[a + start] - bounds[text])
            hits.append((text, item, begin, int(place[a + end - 1] - bounds[text]) + 1, edits))
    return hits


def passage_blocks(benchmark: DataFrame) -> list[Passages]:
    """All passages, in blocks of about ``BLOCK_OF_PASSAGES`` bytes by the item's hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "text is not null"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_OF_PASSAGES))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = []
    for block in range(blocks):
        rows = items.where(number == block).collect()
        out.append(Passages(sorted((tuple(r) for r in rows), key=repr)))
    return out


def contaminated_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every passage found; UTF-8 byte places."""

    def hits_of(passages: Passages) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                keys = batch.column(0).to_pylist()
                data, bounds = text_bytes(batch.column(1))
                for first, last in row_blocks(bounds):
                    inner = bounds[first : last + 1]
                    hits = passage_hits(own, data[inner[0] : inner[-1]], inner - inner[0])
                    columns = [
                        pa.array([keys[first + h[0]] for h in hits], pa.int64()),
                        pa.array([own.ids[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int64()),
                        pa.array([h[3] for h in hits], pa.int64()),
                        pa.array([h[4] for h in hits], pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, ["doc_id", "item_id", "start", "end", "edits"]
                    )

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), HITS)

    found = [hits_of(passages) for passages in passage_blocks(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def is_contaminated(docs: DataFrame, benchmark: DataFrame, text: Column) -> Column:
    """Whether a text holds any passage; one column over the texts, nothing shuffled."""
    answer = F.lit(False)
    for passages in passage_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(texts: pa.Array, shared=shared) -> pa.Array:
            data, bounds = text_bytes(texts)
            held = np.zeros(len(texts), bool)
            for first, last in row_blocks(bounds):
                inner = bounds[first : last + 1]
                for hit in passage_hits(shared.value, data[inner[0] : inner[-1]], inner - inner[0]):
                    held[first + hit[0]] = True
            give_back()
            return pa.array(held)

        answer = answer | F.arrow_udf(lambda texts, run=run: run(texts), T.BooleanType())(text)
    return answer
