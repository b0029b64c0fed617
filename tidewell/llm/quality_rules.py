"""Quality rules whose cutoffs carry a guarantee on false rejection, stratum by stratum.

Fixed base rules come first. Beyond them each document has a few signs of junk (symbols, line
and word repetition, odd word lengths, capitals, few different words), all turned so
that more is worse, and a rule rejects above a cutoff. The cutoffs are found so:

1. Labelled documents fall into two folds by the CRC-32 of their id. On the first fold, all
   of it, a *path* is laid: starting with no rule, always the tightening of one
   rule's cutoff comes next that rejects most junk for the good documents it costs. Cutoffs
   are exact order statistics that Spark counts, some bits of the values in a pass; then documents
   are counted by the first cutoff of each rule that they exceed, and steps follow from these counts. Steps
   are nested, so a document's place on the path is the first step that rejects it. A
   stratum with enough labels has its own path, others the common one.
2. The second fold, all of it, is the holdout. Per stratum and step Spark counts the good
   documents rejected so far. Step by step the exact binomial tail tests whether the
   rate of false rejection exceeds ``risk``; the last step before the first that fails is
   the stratum's cutoff. Such a fixed sequence needs no correction for its length, and the
   level is divided by the number of strata (Bonferroni). So with probability
   ``1 - delta`` at most ``risk`` of the good documents are falsely rejected in every
   stratum at once, base rules aside. A stratum with too few labels to show that gets no
   cutoff: its documents are judged by the base rules alone.

The texts are read once; everything later works on the staged numbers. A stratum is
the document's language, a null one is ``und``.

Edge cases: null, empty and blank texts have no words and fail the base rules; a text of
any length is handled whole, at the cost of its own size; repeated rows are judged
alike, and a repeated id counts once among the labels, by its least row; of conflicting
labels of an id the highest counts; a null id has no label; a value equal to a cutoff is not
rejected; empty tables give no rows, no labels no cutoffs; only doc_id, text and lang of the
documents are read, so clashing names of other columns do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import row_blocks, scratch, text_bytes
from tidewell.workspace import Workspace

# Fixed values of the contract: the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

# The guarantee: rate of false rejection, and the chance of missing it anywhere.
RISK, DELTA = 0.02, 0.05

# Every FOLDS-th labelled id lays the paths, the others are the holdout.
FOLDS = 3

# Labelled documents of a stratum and class that lay its own path, at least.
OWN_PATH = 100

# Steps of a path at most; tail probabilities, among good ones, that cutoffs lie at.
STEPS = 40
TAILS = (0.0, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02, 0.03)

# Different cells of cutoffs exceeded that come to the driver; of more, Spark counts each step.
CELLS = 500_000
# Bits of a value that each pass for its order statistics tells apart.
PASSES = (13, 13, 13, 13, 12)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_different_words", "n_capitals", "n_marks",
)
SIGNS = (
    "symbols", "duplicate_lines", "repeated_words", "long_words", "short_words",
    "few_words", "capitals", "marks",
)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def _repeats(words: list[bytes]) -> tuple[int, int]:
    """(words in three-word windows that occur twice or more, different words)."""
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(ids) < 3:
        return 0, len(index)
    size = len(index)
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum()), size


def count_text(text: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    data = np.frombuffer(text, np.uint8)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated, different = _repeats(words)
    in_words = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    return (
        len(words), int(in_words.sum()), int(_SYMBOL[data].sum()), len(lines),
        len(lines) - len(set(lines)), repeated, different,
        int(_CAPITAL[data].sum()), int(_MARK[data].sum()),
    )


def text_counts(text: Column) -> Column:
    """A struct of the ``COUNTS`` of a text column, all long; a null is an empty text."""

    def run(texts: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        rows = []
        for first, last in row_blocks(bounds):
            own = bounds[first : last + 1]
            raw = data[own[0] : own[-1]].tobytes()
            cuts = (own - own[0]).tolist()
            rows += [count_text(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
        columns = zip(*rows) if rows else [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))

    kind = "struct<" + ", ".join(f"{name}: bigint" for name in COUNTS) + ">"
    return F.arrow_udf(run, kind)(text)


def base_failed() -> Column:
    """Too few words, or too many in repeated windows."""
    few = F.col("n_words") < LEAST_WORDS
    return few | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def signs() -> Column:
    """An array of the ``SIGNS`` of the counts, each greater the worse."""

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1)).cast("double")

    return F.array(
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("word_chars", "n_words"),
        -share("word_chars", "n_words"),
        -share("n_different_words", "n_words"),
        share("n_capitals", "word_chars"),
        share("n_marks", "n_words"),
    )


Path = list[tuple[int, float]]
# Of the documents no step rejects yet: junk and good ones by rule and first cutoff exceeded.
Tally = Callable[[list[int]], tuple[np.ndarray, np.ndarray]]


def tail_ranks(n: int) -> list[int]:
    """Places, from 0, of the ``TAILS`` among ``n`` values in ascending order."""
    return [int(np.ceil((n - 1) * (1 - t))) for t in TAILS]


def first_exceeded(values: np.ndarray, cutoffs: list[np.ndarray]) -> np.ndarray:
    """For each row and sign the first of its falling cutoffs that it exceeds; their number if none."""
    return np.stack([(values[:, [i]] <= cuts).sum(axis=1) for i, cuts in enumerate(cutoffs)], axis=1)


def counted_cells(exceeded: np.ndarray, good: np.ndarray, n: np.ndarray) -> Tally:
    """The tally of cells that so many documents are in."""

    def tally(level: list[int]) -> tuple[np.ndarray, np.ndarray]:
        left = (exceeded >= np.array(level)).all(axis=1)
        both = []
        for own in (left & ~good, left & good):
            counts = [np.bincount(e, n[own], len(TAILS) + 1) for e in exceeded[own].T]
            both.append(np.array(counts).astype(np.int64))
        return both[0], both[1]

    return tally


def steps_of(cutoffs: list[np.ndarray], tally: Tally, steps: int = STEPS) -> Path:
    """(sign, cutoff) of each step, each tightening one rule.

    The next step rejects most junk for each good document it costs, one more being
    counted; of equal ones the first rule's.
    """
    level = [0] * len(cutoffs)
    path: Path = []
    while len(path) < steps:
        best = None
        junk, good = (counts.cumsum(axis=1) for counts in tally(level))
        for sign, cuts in enumerate(cutoffs):
            for at in range(level[sign], len(cuts)):
                if junk[sign, at]:
                    worth = int(junk[sign, at]) / (1 + int(good[sign, at]))
                    if best is None or worth > best[0]:
                        best = (worth, sign, at)
        if best is None:
            break
        _, sign, at = best
        path.append((sign, float(cutoffs[sign][at])))
        level[sign] = at + 1
    return path


def lay_path(values: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Path:
    """The path that documents in memory lay; cutoffs lie at tails of the good ones."""
    if not good.any() or good.all():
        return []
    ordered = np.sort(values[good], axis=0)
    cutoffs = [np.unique(column[tail_ranks(len(column))])[::-1] for column in ordered.T]
    return steps_of(cutoffs, counted_cells(first_exceeded(values, cutoffs), good, np.ones(len(good))), steps)


def binomial_tail(failures: int, trials: int, rate: float) -> float:
    """The exact chance of at most ``failures`` in ``trials`` of the given rate."""
    if failures >= trials:
        return 1.0
    if failures > trials * rate:
        # Beyond the mean; the tests need no more than that it is no small chance.
        return 1.0 - binomial_tail(trials - failures - 1, trials, 1.0 - rate)
    log = (
        math.lgamma(trials + 1) - math.lgamma(failures + 1) - math.lgamma(trials - failures + 1)
        + failures * math.log(rate) + (trials - failures) * math.log1p(-rate)
    )
    term = total = math.exp(log)
    for i in range(failures, 0, -1):
        term *= i / (trials - i + 1) * (1 - rate) / rate
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, total)


def certified_steps(
    rejected_at: dict[int, int], trials: int, steps: int, risk: float, level: float
) -> int:
    """How many steps of a path pass the sequence of tests.

    ``rejected_at`` counts the good holdout documents by the step that first rejects them,
    from 1.
    """
    failures = 0
    for step in range(1, steps + 1):
        failures += rejected_at.get(step, 0)
        if not trials or binomial_tail(failures, trials, risk) > level:
            return step - 1
    return steps


def first_step(paths: dict[str | None, Path], stratum: Column, values: Column) -> Column:
    """The first step, from 1, of the stratum's path that rejects; 0 if none does."""
    common = paths.get(None, [])

    def run(strata: pa.Array, rows: pa.Array) -> pa.Array:
        matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SIGNS))
        coded = strata.dictionary_encode()
        which = coded.indices.to_numpy()
        found = np.zeros(len(matrix), np.int32)
        for number, name in enumerate(coded.dictionary.to_pylist()):
            own = np.flatnonzero(which == number)
            for step, (sign, cutoff) in reversed(list(enumerate(paths.get(name, common), 1))):
                found[own[matrix[own, sign] > cutoff]] = step
        return pa.array(found)

    return F.arrow_udf(run, "int")(stratum, values)


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good, path fold) of every labelled id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg((F.max("quality") == 1).alias("good"))
        .withColumn("lays_path", crc % FOLDS == 0)
    )


def _by_path(batch: pa.RecordBatch, names: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(path, signs, good) of a batch's documents for every path they lay; None is the common one."""
    signs = batch.column("signs").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SIGNS)) + 0.0
    good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
    strata = np.array(batch.column("stratum").to_pylist(), object)
    for number, name in enumerate(names):
        own = np.ones(len(good), bool) if name is None else strata == name
        if own.any():
            yield number, signs[own], good[own]


def _in_order(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = np.ascontiguousarray(values).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.uint64(bits).view(np.float64))


def good_cutoffs(
    rows: DataFrame, names: list[str | None], trials: list[int]
) -> list[list[np.ndarray]]:
    """The falling cutoffs of each path and sign, exactly at the tails of its ``trials`` good documents.

    A pass counts the values that begin with bits where a cutoff lies by some more bits of them, so
    what comes to the driver is bounded whatever the number of documents.
    """
    places = {
        (path, sign): [(0, rank) for rank in tail_ranks(n)]
        for path, n in enumerate(trials)
        for sign in range(len(SIGNS))
    }
    known = 0
    for width in PASSES:
        begun = {key: np.array(sorted({start for start, _ in at}), np.uint64) for key, at in places.items()}
        shifts = np.uint64(64 - known), np.uint64(64 - known - width)

        def run(batches: Iterator[pa.RecordBatch], begun=begun, shifts=shifts) -> Iterator[pa.RecordBatch]:
            counted: Counter[tuple[int, int, int]] = Counter()
            for batch in batches:
                for path, signs, good in _by_path(batch, names):
                    keys = _in_order(signs[good])
                    for sign, column in enumerate(keys.T):
                        if shifts[0] < 64:
                            column = column[np.isin(column >> shifts[0], begun[path, sign])]
                        starts, n = np.unique(column >> shifts[1], return_counts=True)
                        counted.update(
                            {(path, sign, k): c for k, c in zip(starts.view(np.int64).tolist(), n.tolist())}
                        )
            columns = [pa.array([k[i] for k in counted], pa.int64()) for i in range(3)]
            columns.append(pa.array(list(counted.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["path", "sign", "start", "n"])

        found = rows.where("good").mapInArrow(run, "path long, sign long, start long, n long")
        found = found.groupBy("path", "sign", "start").agg(F.sum("n").alias("n")).toArrow().to_pydict()
        counts: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for path, sign, start, n in zip(*found.values()):
            start %= 1 << 64
            counts.setdefault((path, sign, start >> width), []).append((start, n))
        for (path, sign), at in places.items():
            longer = []
            for start, rank in at:
                for child, n in sorted(counts[path, sign, start]):
                    if rank < n:
                        longer.append((child, rank))
                        break
                    rank -= n
            places[path, sign] = longer
        known += width
    return [
        [np.unique([_value(key) for key, _ in places[path, sign]])[::-1] for sign in range(len(SIGNS))]
        for path in range(len(trials))
    ]


def path_cells(rows: DataFrame, names: list[str | None], cutoffs: list[list[np.ndarray]]) -> DataFrame:
    """(path, good, cell, n): documents by the first cutoff they exceed of every sign, as the cell's digits."""
    base = len(TAILS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[tuple[int, bool, int]] = Counter()
        for batch in batches:
            for path, signs, good in _by_path(batch, names):
                cells = first_exceeded(signs, cutoffs[path]) @ base ** np.arange(len(SIGNS))
                counted.update(zip([path] * len(good), good.tolist(), cells.tolist()))
            if len(counted) > CELLS:
                yield given(counted)
                counted.clear()
        yield given(counted)

    def given(counted: Counter[tuple[int, bool, int]]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.bool_(), pa.int64()
        columns = [pa.array([k[i] for k in counted], kind) for i, kind in enumerate(kinds)]
        columns.append(pa.array(list(counted.values()), pa.int64()))
        return pa.RecordBatch.from_arrays(columns, ["path", "good", "cell", "n"])

    found = rows.mapInArrow(run, "path long, good boolean, cell long, n long")
    return found.groupBy("path", "good", "cell").agg(F.sum("n").alias("n"))


def _spark_tally(cells: DataFrame) -> Tally:
    """As ``counted_cells``, of cells too many for the driver."""
    base = len(TAILS) + 1
    digits = [F.expr(f"cell div {base**sign} % {base}") for sign in range(len(SIGNS))]

    def tally(level: list[int]) -> tuple[np.ndarray, np.ndarray]:
        left = cells
        for digit, at in zip(digits, level):
            left = left.where(digit >= at)
        pairs = F.array(*(F.struct(F.lit(i).alias("sign"), d.alias("at")) for i, d in enumerate(digits)))
        each = left.select("good", "n", F.explode(pairs).alias("pair"))
        both = np.zeros((2, len(SIGNS), base), np.int64)
        for good, sign, at, n in each.groupBy("good", "pair.sign", "pair.at").agg(F.sum("n")).collect():
            both[int(good), sign, at] = n
        return both[0], both[1]

    return tally


def lay_paths(labelled: DataFrame, workspace: Workspace, most_cells: int = CELLS) -> dict[str | None, Path]:
    """Each stratum's path, and the common one as that of None, laid by all rows with ``lays_path``."""
    rows = labelled.where("lays_path").select("stratum", "good", "signs")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("stratum", "good").count().collect()}
    if not counts:
        return {}
    trials = {None: sum(n for (_, good), n in counts.items() if good)}
    for name in sorted({stratum for stratum, _ in counts}):
        if min(counts.get((name, True), 0), counts.get((name, False), 0)) >= OWN_PATH:
            trials[name] = counts[name, True]
    if trials[None] in (0, sum(counts.values())):
        return {None: []}
    names = list(trials)
    cutoffs = good_cutoffs(rows, names, list(trials.values()))
    cells = workspace.stage(path_cells(rows, names, cutoffs), "cells")
    if cells.count() > most_cells:
        tallies = [_spark_tally(cells.where(F.col("path") == i)) for i in range(len(names))]
    else:
        found = cells.toArrow()
        path, good, cell, n = (found[c].to_numpy() for c in ("path", "good", "cell", "n"))
        digits = cell[:, None] // (len(TAILS) + 1) ** np.arange(len(SIGNS)) % (len(TAILS) + 1)
        tallies = [
            counted_cells(digits[path == i], good[path == i].astype(bool), n[path == i]) for i in range(len(names))
        ]
    return {name: steps_of(cuts, tally) for name, cuts, tally in zip(names, cutoffs, tallies)}


def rule_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = RISK,
    delta: float = DELTA,
    workspace: Workspace | None = None,
) -> DataFrame:
    """A row for each document: its ``COUNTS``, ``base_failed``, ``kept`` and why.

    ``stratum`` is the language; ``step`` the first step of the stratum's path that
    rejects the document, 0 for none; ``certified`` how many steps are in force there;
    ``rule`` the sign whose rule rejects it, or null.
    """
    workspace = workspace or scratch(docs.sparkSession, "rules")
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        stratum.alias("stratum"),
        text_counts(F.col("text")).alias("counts"),
    ).select("doc_id", "stratum", "counts.*")
    rows = workspace.stage(
        counted.withColumn("base_failed", base_failed()).withColumn("signs", signs()), "counts"
    )
    one = (
        rows.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(F.struct("stratum", "base_failed", "signs")).alias("row"))
        .select("doc_id", "row.*")
    )
    labelled = workspace.stage(
        one.where("not base_failed").join(_labels(labels), "doc_id"), "labelled"
    )
    paths = lay_paths(labelled, workspace)
    step = first_step(paths, F.col("stratum"), F.col("signs"))
    held = labelled.where("good and not lays_path").withColumn("step", step)
    tallies: dict[str, dict[int, int]] = {}
    for name, at, n in held.groupBy("stratum", "step").count().collect():
        tallies.setdefault(name, {})[at] = n
    level = delta / max(1, len(tallies))
    in_force = {
        name: certified_steps(
            tally, sum(tally.values()), len(paths.get(name, paths.get(None, []))), risk, level
        )
        for name, tally in tallies.items()
    }
    certified, rule = F.lit(0), F.lit(None).cast("string")
    for name, most in sorted(in_force.items()):
        certified = F.when(F.col("stratum") == name, most).otherwise(certified)
    for name in sorted(in_force):
        names = [SIGNS[sign] for sign, _ in paths.get(name, paths.get(None, []))]
        if names:
            listed = F.array(*map(F.lit, names))
            rule = F.when(F.col("stratum") == name, F.get(listed, F.col("step") - 1)).otherwise(rule)
    return (
        rows.withColumn("step", step)
        .withColumn("certified", certified)
        .withColumn("rejected", F.col("step").between(1, F.col("certified")))
        .withColumn("rule", F.when(F.col("rejected"), rule))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))
        .select("doc_id", "stratum", *COUNTS, "base_failed", "kept", "step", "certified", "rule")
    )
