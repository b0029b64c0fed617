"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan.

A run is a stretch of words in which words ``q`` apart are identical, ``q`` being the
smallest such period, at least ``max(shortest, 2 * q)`` words long, that no neighbouring
word extends. Whatever its period, every word of a run occurs twice in it at least.

1. A word that occurs once in its segment (at first the text) can't join a run, so it
   splits the segment. Both parts are counted anew, until no segment changes. Nearly all
   of ordinary prose is gone after a few rounds.
2. The segments left are scanned lag by lag. Lags below ``FIRST_SCALE`` compare the
   segment with itself. Longer lags are scanned by scales Q <= q < 2Q: a run with such a
   period holds a whole block of Q/2 words at a multiple of Q/2 together with its copy
   q words on, so only lags at which such a block recurs are followed, left and right,
   to where they end. Blocks are told apart by exact ranks, not by fingerprints.

A period that is a multiple of a smaller one of the same stretch is not the smallest and is
left out. Work is a sort of the words and about (segment length) x (its logarithm);
memory is that of one block of texts, or of one text if it is longer.

Edge cases: null, empty and blank texts have no words, no run and an empty collapsed
text; every row is judged by itself, so repeated rows get equal results; ties are
decided by start, then period; an empty table gives no rows; extra columns are ignored
by the column form, which leaves the frame as it is.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from tidewell.llm.common import row_blocks, text_bytes

# Fixed values of the contract: a run has so many words and so many periods at least.
SHORTEST, PERIODS = 12, 2

# The first scale of lags that is scanned by blocks; a power of two.
FIRST_SCALE = 16

# Rounds in which all segments are counted at once; what still changes is split one by one.
ROUNDS = 64

RESULT = (
    "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>,"
    " collapsed: string>"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word occurred last before, and next after, its place."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _split_one(
    low: int, high: int, before: np.ndarray, after: np.ndarray, shortest: int
) -> list[tuple[int, int]]:
    """One segment split to the end, looking for lone words from both ends at once.

    A split costs the length of its shorter part, so depth does no harm.
    """
    stable, waiting = [], [(low, high)]
    while waiting:
        low, high = waiting.pop()
        if high - low < shortest:
            continue
        for step in range((high - low + 1) // 2):
            cut = next(
                (at for at in (low + step, high - 1 - step) if before[at] < low and after[at] >= high),
                None,
            )
            if cut is not None:
                waiting += [(low, cut), (cut + 1, high)]
                break
        else:
            stable.append((low, high))
    return stable


def frequent_segments(
    words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST
) -> list[tuple[int, int]]:
    """Segments of the texts in which every word occurs twice or more, none shorter than ``shortest``."""
    if not len(words):
        return []
    before, after = _neighbours(words)
    low, high = bounds[:-1], bounds[1:]
    stable: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        long = high - low >= shortest
        low, high = low[long], high[long]
        if not len(low):
            break
        size = high - low
        segment = np.repeat(np.arange(len(low)), size)
        place = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        lone = (before[place] < low[segment]) & (after[place] >= high[segment])
        changed = np.zeros(len(low), bool)
        changed[segment[lone]] = True
        stable += zip(low[~changed].tolist(), high[~changed].tolist())
        # Ends, cuts and beginnings in order, in half words so that a cut has two sides: a
        # new segment lies between two neighbours of which the first is no end.
        ends = 2 * high[changed]
        cuts = np.concatenate([ends, 2 * place[lone] + 1, 2 * low[changed]])
        order = np.argsort(cuts, kind="stable")
        inside = order[:-1] >= len(ends)
        low, high = (cuts[order[:-1]][inside] + 1) // 2, cuts[order[1:]][inside] // 2
    for first, last in zip(low.tolist(), high.tolist()):
        stable += _split_one(first, last, before, after, shortest)
    return sorted(stable)


class _Runs:
    """Runs found so far in a segment, by period, in order of their starts."""

    def __init__(self, shortest: int) -> None:
        self.shortest = shortest
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, dict[int, int]] = {}

    def covered(self, start: int, end: int, lag: int) -> bool:
        """Whether a run whose period divides ``lag`` holds the whole stretch."""
        for period, starts in self.starts.items():
            if period < lag and lag % period == 0:
                at = bisect_right(starts, start) - 1
                if at >= 0 and self.ends[period][starts[at]] >= end:
                    return True
        return False

    def add(self, start: int, end: int, lag: int) -> None:
        if end - start < max(self.shortest, PERIODS * lag) or self.covered(start, end, lag):
            return
        known = self.ends.setdefault(lag, {})
        if start not in known:
            insort(self.starts.setdefault(lag, []), start)
            known[start] = end

    def longer_than(self, length: int) -> list[tuple[int, int, int]]:
        return [
            (start, end, period)
            for period, ends in self.ends.items()
            for start, end in ends.items()
            if end - start >= length
        ]


def _matching_to(x: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``lag`` later."""
    step, last = 32, len(x) - lag
    while at < last:
        stop = min(at + step, last)
        other = np.flatnonzero(x[at:stop] != x[at + lag : stop + lag])
        if len(other):
            return at + int(other[0])
        at, step = stop, 2 * step
    return last


def _matching_from(x: np.ndarray, at: int, lag: int) -> int:
    """The least place from which on, up to ``at``, words equal those ``lag`` later."""
    step = 32
    while at > 0:
        start = max(0, at - step)
        other = np.flatnonzero(x[start:at] != x[start + lag : at + lag])
        if len(other):
            return start + int(other[-1]) + 1
        at, step = start, 2 * step
    return 0


def _scan_scale(x: np.ndarray, rank: np.ndarray, scale: int, runs: _Runs) -> None:
    """All runs with a period in [scale, 2 * scale). ``rank`` tells blocks of scale/2 words apart."""
    block, n = scale // 2, len(x)
    points = np.arange(0, n - scale - block + 1, block)
    if not len(points):
        return
    padded = np.concatenate([rank, np.full(2 * scale, -1, rank.dtype)])
    ahead = np.lib.stride_tricks.sliding_window_view(padded, scale)[points + scale]
    row, column = np.nonzero(ahead == rank[points][:, None])
    point, lag = points[row], column + scale
    open_ = lag <= n // PERIODS
    for start, end, period in runs.longer_than(scale + block):
        some = slice(*np.searchsorted(point, [start, end - scale - block + 1]))
        open_[some] &= (lag[some] % period != 0) | (point[some] + lag[some] + block > end)
    done: dict[int, int] = {}
    for at, q in zip(point[open_].tolist(), lag[open_].tolist()):
        if at + q + block <= done.get(q, 0):
            continue
        start, end = _matching_from(x, at, q), _matching_to(x, at + block, q) + q
        done[q] = end
        runs.add(start, end, q)


def segment_runs(x: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one segment, by start, then period."""
    n, runs = len(x), _Runs(shortest)
    for lag in range(1, min(FIRST_SCALE - 1, n // PERIODS) + 1):
        equal = np.zeros(n - lag + 2, np.int8)
        equal[1:-1] = x[lag:] == x[:-lag]
        edges = np.flatnonzero(np.diff(equal))
        for start, end in zip(edges[::2].tolist(), (edges[1::2] + lag).tolist()):
            runs.add(start, end, lag)
    rank, width = x.astype(np.int64), 1
    scale = FIRST_SCALE
    while scale <= n // PERIODS:
        while width < scale // 2:
            joined = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
            rank, width = np.unique(joined, return_inverse=True)[1], 2 * width
        _scan_scale(x, rank, scale, runs)
        scale *= 2
    return sorted((start, end - start, period) for start, end, period in runs.longer_than(0))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those of a run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    begun = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        begun[start + period] += 1
        begun[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(begun[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


class _Numbers(dict):
    """A number for each word; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def find_runs(
    texts: list[bytes], shortest: int = SHORTEST
) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each text.

    Words are cut at the six ASCII white-space characters, as ``bytes.split`` does.
    """
    number = _Numbers().__getitem__
    words = [text.split() for text in texts]
    sizes = [len(own) for own in words]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = np.fromiter((number(word) for own in words for word in own), np.int64, bounds[-1])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in frequent_segments(coded, bounds, shortest):
        text = int(np.searchsorted(bounds, low, side="right")) - 1
        shift = low - int(bounds[text])
        ids = np.unique(coded[low:high], return_inverse=True)[1]
        runs[text] += [(start + shift, *rest) for start, *rest in segment_runs(ids, shortest)]
    return [(n, own, _collapsed(w, own)) for n, own, w in zip(sizes, runs, words)]


def periodic_runs(text: Column, shortest: int = SHORTEST) -> Column:
    """A struct of a text column: ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    ``collapsed`` holds the words joined by one space, without those that a run holds
    after its first period.
    """

    def run(texts: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        raw = data.tobytes()
        found = []
        for first, last in row_blocks(bounds):
            own = bounds[first : last + 1].tolist()
            found += find_runs([raw[a:b] for a, b in zip(own, own[1:])], shortest)
        sizes, runs, collapsed = zip(*found) if found else ((), (), ())
        ends = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
        flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        parts = [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)]
        listed = pa.ListArray.from_arrays(
            pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_RUN))
        )
        joined = pa.array(collapsed, pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), listed, joined], ["n_words", "runs", "collapsed"]
        )

    return F.arrow_udf(run, RESULT)(text)


def run_digest(result: Column) -> list[Column]:
    """Digest columns of ``periodic_runs``: the number of runs, the longest one, two hashes.

    The longest run is the one with the smallest start, then period, of equal lengths.
    """
    runs = result["runs"]
    ranked = F.transform(
        runs, lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("size"))
    )
    best = F.array_min(ranked)
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return [
        F.size(runs).cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["size"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["size"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(result["collapsed"].cast("binary"), 256).alias("collapsed_sha256"),
    ]


def with_planted_period(key: Column, text: Column) -> Column:
    """The text, its rear made periodic in one row of ten, as its key's CRC-32 says.

    With h the CRC-32 of the key's decimal text and g = h div 10, rows of h mod 10 = 0
    that have n > 0 words keep the first a = g mod n; each later word i becomes word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). Their words are joined by
    one space. Other rows, those of a null key too, stay as they are.
    """

    def run(hashes: pa.Array, texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        for at, h in enumerate(hashes.to_pylist()):
            if h is None or h % 10 or not rows[at]:
                continue
            words, g = rows[at].encode("utf-8").split(), h // 10
            if words:
                a = g % len(words)
                period = 1 + (len(words) - a) // (3 + g % 8)
                rear = (words[a : a + period] * (3 + g % 8))[: len(words) - a]
                rows[at] = b" ".join(words[:a] + rear).decode("utf-8")
        return pa.array(rows, pa.string())

    return F.arrow_udf(run, "string")(F.crc32(key.cast("string").cast("binary")), text)
