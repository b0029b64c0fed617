"""Secret scanning: fixed patterns, and a battery of randomness tests.

Base patterns find assignments, access keys and long hexadecimal runs. The battery
looks at every other long run of code characters, whole and in the parts between its
separators (a key may follow a name and '=', or be the end of a path): it infers the part's encoding,
tests the symbols for uniformity (chi-squared, a cell for each symbol), for runs about
the median, for serial correlation, and for too few changes between digits, capitals
and small letters, and combines the four into one probability of so odd a run
under randomness. How random ordinary names of the same length and alphabet look is
learned from the corpus itself: the words and numbers of all documents, each as often as it
is counted, are dealt to groups in Spark, written as identifiers and paths are and
cut into controls, which tasks count for every class that has candidates, however few.
Controls have the least length of their class. A candidate's p-value is the share of
controls of its class that look at least as random; the Benjamini-Hochberg
rule over all candidates of the corpus sets one greatest p-value, so where length
gives no power nothing is reported.

Runs of letters alone or of digits alone are not tested: long words and numbers are such
runs, and no test tells a key of one kind of character from them. Short runs have little power:
of 20 characters one candidate in nine must be a key for any to be reported.

Edge cases: null and empty texts have no spans; repeated rows are scanned alike; texts and
runs of any length are scanned whole; of parts that lie in each other the longest is
reported; a corpus without candidates, or without any prose to compare them with, has no
thresholds and only base spans; an empty table gives no rows; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.llm.common import by_blocks, giving_back, scratch

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

# A candidate: this many code characters or more, a digit and a letter among them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# A run's parts: what has no inner '=', no base64 symbol, no base64url symbol, and none of them.
PARTS = [re.compile(p) for p in (r"[^=]+", r"[^=/+]+", r"[^=_-]+", r"[^=/+_-]+")]
WORD = re.compile(r"[A-Za-z]+|[0-9]+")
# Controls of a class at least, as far as the prose goes; words of a group, which a task writes at a time.
CONTROLS = 10_000
GROUP_WORDS = 8_192
# Up to so many words each is dealt by itself; of more, common ones evenly and others in strands.
PROSE_WORDS = 1 << 18
# Different words a task counts before it passes them on.
KNOWN_WORDS = 200_000
# The least length of each length class, padding not counted: eight classes an octave. Longer
# runs are all of the last class, whose controls look more random than theirs would.
LEAST_LENGTHS = sorted({int(20 * 2 ** (i / 8)) for i in range(41)})
FALSE_DISCOVERIES = 0.05
# Steps a decade in which probabilities are counted, and decades.
STEPS, DECADES = 4, 16

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
ALPHABETS = {
    "hex": (_DIGITS + "abcdef", _DIGITS + "ABCDEF"),
    "base32": (_UPPER + "234567",),
    "lower36": (_DIGITS + _LOWER,),
    "upper36": (_DIGITS + _UPPER,),
    "base62": (_DIGITS + _UPPER + _LOWER,),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/",),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_",),
}
# Every alphabet, and the number it has in a class.
EVERY = [alphabet for alphabets in ALPHABETS.values() for alphabet in alphabets]
NUMBER = {alphabet: i for i, alphabet in enumerate(EVERY)}
# How controls are written: what is done to words, what is between them, letters from number to number.
CASES = (str.lower, str.upper, str.title)
JOINED = ("", "/", "+", "_", "-")
SPACING = (6, 10, 16)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """All base spans in order of start, then of kind."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        for match in ASSIGN.finditer(text):
            if len(match.group(2)) >= LEAST_VALUE:
                spans.append(("assign", *match.span()))
    if "AKIA" in text:
        for match in ACCESS.finditer(text):
            if match.end() - match.start() >= LEAST_ACCESS:
                spans.append(("access", *match.span()))
    spans.extend(("hex", *match.span()) for match in HEX.finditer(text))
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def infer_encoding(run: str) -> tuple[str, str] | None:
    """The first, so narrowest, encoding whose alphabet has all symbols, without padding."""
    symbols = set(run.rstrip("="))
    for name, alphabets in ALPHABETS.items():
        for alphabet in alphabets:
            if symbols <= set(alphabet):
                return name, alphabet
    return None


def _erfc(values: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, values.ravel().tolist()), float, values.size).reshape(values.shape)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def _chi_squared_tail(value: np.ndarray, freedom: int) -> np.ndarray:
    """Upper tail by the cube-root normal approximation."""
    spread = 2 / (9 * freedom)
    z = (np.cbrt(value / freedom) - (1 - spread)) / math.sqrt(spread)
    return 0.5 * _erfc(z / math.sqrt(2))


def _kinds(alphabet: str) -> np.ndarray:
    """0 for digits, 1 for capitals, 2 for small letters, 3 for others."""
    return np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in alphabet])


def _by_value(function: Callable[[np.ndarray], np.ndarray], values: np.ndarray) -> np.ndarray:
    """The function of whole numbers, worked out once for each where many are alike."""
    if not len(values):
        return np.zeros(0)
    least = values.min()
    if values.max() - least > 2 * len(values):
        return function(values)
    seen = np.bincount(values - least)
    there = np.flatnonzero(seen)
    known = np.empty(len(seen))
    known[there] = function(there + least)
    return known[values - least]


def _combined(
    alphabet: str,
    n: int,
    squares: np.ndarray,
    high: np.ndarray,
    runs: np.ndarray,
    serial: np.ndarray,
    changes: np.ndarray,
) -> np.ndarray:
    """One probability from the four tests of runs of ``n`` symbols.

    Cells of the uniformity test hold one symbol each, also where less than one
    is expected in a cell: what counts is how this compares with the controls.
    """
    size = len(alphabet)

    def uniform(squares: np.ndarray) -> np.ndarray:
        return _chi_squared_tail(squares.astype(float) * size / n - n, size - 1)

    def run_test(both: np.ndarray) -> np.ndarray:
        high, runs = both // (n + 1), both % (n + 1)
        low = n - high
        mean = 1 + 2 * high * low / n
        variance = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        return np.where(high * low > 0, _two_sided((runs - mean) / np.sqrt(variance)), 2.0 ** (1 - n))

    share = np.bincount(_kinds(alphabet)) / size
    two, three = float((share**2).sum()), float((share**3).sum())
    # Neighbouring changes depend on each other where kinds differ in size.
    spread = (n - 1) * two * (1 - two) + 2 * (n - 2) * (three - two * two)

    def change(changes: np.ndarray) -> np.ndarray:
        return 0.5 * _erfc(((n - 1) * (1 - two) - changes) / math.sqrt(2 * max(spread, 1e-9)))

    def log(p: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(p, 1e-300))

    half = -(
        _by_value(lambda v: log(uniform(v)), squares)
        + _by_value(lambda v: log(run_test(v)), high * (n + 1) + runs)
        + log(serial)
        + _by_value(lambda v: log(change(v)), changes)
    )
    return np.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6)


def randomness(codes: np.ndarray, alphabet: str) -> np.ndarray:
    """Combined probability of runs at least as odd as each row, were they random over the alphabet."""
    rows, n = codes.shape
    size = len(alphabet)
    cell = (codes + np.arange(rows)[:, None] * size).ravel()
    seen = np.bincount(cell, minlength=rows * size).reshape(rows, size)
    above = codes >= size / 2
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    centred = codes - codes.mean(axis=1, keepdims=True)
    power = (centred**2).sum(axis=1)
    product = (centred[:, 1:] * centred[:, :-1]).sum(axis=1)
    serial = np.where(power > 0, _two_sided(product / np.maximum(power, 1e-9) * math.sqrt(n)), 0.0)
    kinds = _kinds(alphabet)[codes]
    changes = (kinds[:, 1:] != kinds[:, :-1]).sum(axis=1)
    return _combined(alphabet, n, (seen**2).sum(axis=1), above.sum(axis=1), runs, serial, changes)


class Windows:
    """Running sums of a text, from which the tests of its windows of any length are taken."""

    def __init__(self, text: str, alphabet: str) -> None:
        codes = coded(text, alphabet)
        size, kinds = len(alphabet), _kinds(alphabet)[codes]
        above = codes >= size / 2
        self.alphabet, self.codes = alphabet, codes
        # Of symbols: their codes, the squares, how many are high, letters, digits.
        self.single = _running([codes, codes**2, above, (kinds == 1) | (kinds == 2), kinds == 0])
        # Of neighbours: the products, the changes from high to low, the changes of kind.
        self.pairs = _running([codes[1:] * codes[:-1], above[1:] != above[:-1], kinds[1:] != kinds[:-1]])
        # How often each symbol has come, four in a number of 64 bits: one that goes over runs into
        # its neighbour, but the differences of a window, 65,535 at most, are right again.
        seen = np.zeros((len(codes) + 1, -(-size // 4) * 4), np.uint16)
        seen[np.arange(1, len(codes) + 1), codes] = 1
        self.seen = seen.view(np.uint64)
        np.add.accumulate(self.seen, axis=0, out=self.seen)

    def randomness(self, at: np.ndarray, n: int) -> np.ndarray:
        """As the function, of the windows of length ``n`` that begin there and are neither all letters nor all digits."""
        total, power, high, letters, digits = np.ascontiguousarray((self.single[at + n] - self.single[at]).T)
        mixed = (letters < n) & (digits < n)
        at, total, power, high = at[mixed], total[mixed], power[mixed], high[mixed]
        product, turns, changes = np.ascontiguousarray((self.pairs[at + n - 1] - self.pairs[at]).T)
        ends = self.codes[at] + self.codes[at + n - 1]
        # Both of them centred: the power n times, the product n * n times, in whole numbers.
        power = n * power - total**2
        product = n * n * product - n * total * (2 * total - ends) + (n - 1) * total**2
        serial = np.where(power > 0, _two_sided(product / (n * np.maximum(power, 1)) * math.sqrt(n)), 0.0)
        seen = (self.seen[at + n] - self.seen[at]).view(np.uint16).astype(np.float32)
        squares = np.einsum("ij,ij->i", seen, seen).astype(np.int64)
        return _combined(self.alphabet, n, squares, high, 1 + turns, serial, changes)


def _running(columns: list[np.ndarray]) -> np.ndarray:
    """Sums of the columns up to each place, from 0."""
    sums = np.zeros((len(columns[0]) + 1, len(columns)), np.int64)
    for i, column in enumerate(columns):
        np.cumsum(column, out=sums[1:, i])
    return sums


def oddness(p: np.ndarray) -> np.ndarray:
    """The probabilities' steps on a scale where 0 looks most random."""
    return np.minimum(STEPS * DECADES, (-np.log10(np.maximum(p, 1e-300)) * STEPS).astype(int))


def length_class(n: int) -> int:
    return bisect_right(LEAST_LENGTHS, n) - 1


def coded(run: str, alphabet: str) -> np.ndarray:
    place = np.zeros(128, np.int64)
    place[np.frombuffer(alphabet.encode("ascii"), np.uint8)] = np.arange(len(alphabet))
    return place[np.frombuffer(run.encode("ascii"), np.uint8)]


def parts(run: str) -> list[tuple[int, int]]:
    """Begins and ends of the run's different parts that are long enough and neither all letters nor all digits."""
    found = {
        match.span()
        for pattern in PARTS
        for match in pattern.finditer(run)
        if match.end() - match.start() >= 20 and not (match.group().isalpha() or match.group().isdigit())
    }
    return sorted(found)


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, class, oddness) of the runs, and parts of runs, outside every base span."""
    for match in CANDIDATE.finditer(text):
        for start, end in parts(match.group()):
            run = match.group()[start:end]
            start, end = start + match.start(), end + match.start()
            if end == match.start() + len(match.group().rstrip("=")):
                end = match.end()
            if any(a < end and start < b for _, a, b in base):
                continue
            found = infer_encoding(run)
            if found is None:
                continue
            alphabet = found[1]
            step = int(oddness(randomness(coded(run, alphabet)[None], alphabet))[0])
            yield start, end, length_class(len(run)) * len(EVERY) + NUMBER[alphabet], step


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word stands outside all long code runs, in the whole of all documents."""

    def spelled_out(counted: Counter[str]) -> pa.RecordBatch:
        columns = [pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counted.update(WORD.findall(CANDIDATE.sub(" ", text.as_py() or "")))
                if len(counted) > KNOWN_WORDS:
                    yield spelled_out(counted)
                    counted.clear()
        yield spelled_out(counted)

    words = docs.select("text").mapInArrow(giving_back(run), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def word_groups(counts: DataFrame) -> tuple[DataFrame, int]:
    """(group, words) and the number of groups: words as often as they are counted, in an order by hash.

    ``counts`` is read several times and should be a written table. Words go by the hash of the word
    and of which one of its kind it is, so groups are alike in size and in what they hold. Of a word
    that a large corpus has as often as there are groups, each group has equally many, and only what
    is left over goes by hash; such words are at most ``GROUP_WORDS``. A task makes a block of groups,
    and gets a large corpus's words in strands: as one row each ``blocks``-th of a word's occurrences.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / GROUP_WORDS))
    if total > PROSE_WORDS:
        blocks = stride = math.isqrt(groups)
        groups = blocks * -(-groups // blocks)
        rounds = F.expr(f"n div {groups}")
    else:
        blocks, stride, rounds = groups, max(1, total), F.lit(0).cast("long")
    split = counts.select("word", rounds.alias("rounds"), (F.col("n") - rounds * groups).alias("rest"))
    strands = split.where("rest > 0").select(
        "word", "rest", F.explode(F.sequence(F.lit(1), F.least("rest", F.lit(stride)))).alias("first")
    )
    block = F.pmod(F.xxhash64("word", "first"), F.lit(blocks)).cast("int")
    # A group may have nothing but what all have.
    bare = counts.sparkSession.range(groups).select(
        (F.col("id") % blocks).cast("int").alias("block"), F.col("id").cast("int").alias("group")
    )
    each = (
        strands.withColumn("block", block)
        .unionByName(bare, allowMissingColumns=True)
        .repartitionById(blocks, "block")
        .withColumn("i", F.explode_outer(F.sequence("first", "rest", F.lit(stride).cast("long"))))
    )
    within = F.pmod(F.xxhash64(F.lit(11), "word", "i"), F.lit(groups // blocks))
    own = (
        each.withColumn("group", F.coalesce("group", (F.col("block") + blocks * within).cast("int")))
        .groupBy("block", "group")
        .agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("word", "i"))).alias("own"))
    )
    common = split.where("rounds > 0").agg(F.collect_list(F.struct("word", "rounds", "rest")).alias("common"))
    # Of a common word's occurrences the first are the rest, then come those of the groups in turn.
    shared = F.flatten(
        F.transform(
            "common",
            lambda c: F.transform(
                F.sequence(F.lit(1), c["rounds"]),
                lambda i: F.struct(
                    c["word"].alias("word"), (c["rest"] + F.col("group") * c["rounds"] + i).alias("i")
                ),
            ),
        )
    )
    placed = F.transform(
        F.concat("own", shared),
        lambda w: F.struct(F.xxhash64(F.lit(7), w["word"], w["i"]).alias("place"), w["word"].alias("word")),
    )
    words = F.transform(F.sort_array(placed), lambda placed: placed["word"])
    return own.crossJoin(F.broadcast(common)).select("group", words.alias("words")), groups


def ways(alphabet: str) -> list[tuple[Callable[[str], str], str, int]]:
    """What is done to words, what is between them, and letters from number to number, in every way there is."""
    small, capital = "a" in alphabet, "A" in alphabet
    cases = [c for c, fits in zip(CASES, (small, capital, small and capital)) if fits]
    # Words joined by nothing are told apart by capitals or not at all; a text is all in one case.
    joints = [j for j in JOINED if j and j in alphabet] or [""]
    return [(case, joint, spacing) for case in cases for joint in joints for spacing in SPACING]


def spelled(letters: str, digits: list[str], alphabet: str, way: tuple[Callable[[str], str], str, int]) -> str:
    """Words, given as one text with spaces, in the alphabet's symbols, joined in one way, with numbers between."""
    case, joint, spacing = way
    numbers = digits or [str(i) for i in range(100)]
    numbers = [m for w in numbers if (m := "".join(c for c in w if c in alphabet))] or ["2"]
    foreign = {ord(c): None for c in _UPPER + _LOWER if c not in alphabet}
    out, since, used = [], 0, 0
    for word in case(letters).translate(foreign).split():
        out.append(word)
        since += len(word)
        if since >= spacing:
            out.append(numbers[used % len(numbers)])
            since, used = 0, used + 1
    return joint.join(out)


def controls(texts: Iterable[str], alphabet: str, sizes: list[int], want: int, most: int) -> Counter[tuple[int, int]]:
    """How many controls of each length class have each oddness.

    Windows of the class's length tile a text whole. Further texts follow until there are ``want`` windows
    and ``most`` texts; where all texts are too short for that, windows lie closer.
    """
    counted: Counter[tuple[int, int]] = Counter()
    texts = [t for t in texts if len(t) // 2 >= LEAST_LENGTHS[0]]
    made = dict.fromkeys(sizes, 0)
    for i, text in enumerate(texts):
        wanting = [size for size in sizes if i < most or made[size] < want]
        windows = Windows(text, alphabet) if wanting else None
        for size in wanting:
            n = LEAST_LENGTHS[size]
            rooms = [len(t) - min(n, len(t) // 2) + 1 for t in texts]
            stride = n if sum(-(-room // n) for room in rooms) >= want else max(1, min(n, sum(rooms) // want))
            # Controls of too little prose are shorter, so look more random.
            width = min(n, len(text) // 2)
            places = np.arange(0, rooms[i], min(stride, width))
            if places[-1] < rooms[i] - 1:
                places = np.append(places, rooms[i] - 1)
            made[size] += len(places)
            for at in range(0, len(places), 4096):
                # As candidates, controls are neither all letters nor all digits.
                steps = np.bincount(oddness(windows.randomness(places[at : at + 4096], width)))
                counted.update({(size, int(step)): int(steps[step]) for step in np.flatnonzero(steps)})
    return counted


def control_counts(docs: DataFrame, classes: list[int]) -> list[tuple[int, int, int]]:
    """(class, oddness, controls) of the classes, from the words of all documents.

    A group writes its words in one way after the other, from another way on than its neighbour;
    with as many groups as ways one way each will do.
    """
    counts = scratch(docs.sparkSession, "words").stage(word_counts(docs), "counts")
    dealt, groups = word_groups(counts)
    want = -(-CONTROLS // groups)
    lengths: dict[int, list[int]] = {}
    for size in classes:
        lengths.setdefault(size % len(EVERY), []).append(size // len(EVERY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for group, words in zip(batch.column("group"), batch.column("words")):
                group, words = group.as_py(), words.as_py()
                letters = " ".join(w for w in words if w.isalpha())
                digits = [w for w in words if w.isdigit() and len(w) <= 8]
                for number, sizes in lengths.items():
                    alphabet = EVERY[number]
                    all_ways = ways(alphabet)
                    first = group % len(all_ways)
                    most = -(-len(all_ways) // groups)
                    # Where one text is enough for the longest class, the others need not be written.
                    texts: list[str] = []
                    for way in all_ways[first:] + all_ways[:first]:
                        texts.append(spelled(letters, digits, alphabet, way))
                        have = sum(len(t) for t in texts) // LEAST_LENGTHS[max(sizes)]
                        if len(texts) >= most and have >= want + len(texts):
                            break
                    found = controls(texts, alphabet, sizes, want, most)
                    counted.update({(size * len(EVERY) + number, step): n for (size, step), n in found.items()})
        yield _counts(counted)

    found = dealt.mapInArrow(giving_back(run), COUNTS)
    return [tuple(r) for r in found.groupBy("class", "step").agg(F.sum("n").alias("n")).collect()]


COUNTS = "class int, step int, n long"


def _counts(counted: Counter[tuple[int, int]]) -> pa.RecordBatch:
    """Counts by class and step as rows of ``COUNTS``."""
    columns = [
        pa.array([k[0] for k in counted], pa.int32()),
        pa.array([k[1] for k in counted], pa.int32()),
        pa.array(list(counted.values()), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["class", "step", "n"])


def fit_thresholds(docs: DataFrame) -> dict[int, int]:
    """Greatest oddness reported, for each length class that has one; over all documents.

    What comes to the driver is one count for each length class and step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and CANDIDATE.search(text):
                    counted.update((size, step) for _, _, size, step in candidates(text, base_spans(text)))
        yield _counts(counted)

    rows = (
        docs.select("text")
        .mapInArrow(run, COUNTS)
        .groupBy("class", "step")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    if not rows:
        return {}
    found = control_counts(docs, sorted({r["class"] for r in rows}))
    return thresholds([(False, *r) for r in rows] + [(True, *r) for r in found])


def thresholds(counts: list[tuple[bool, int, int, int]]) -> dict[int, int]:
    """Benjamini-Hochberg over the counted candidates; p-values from the counted controls."""
    tested: list[tuple[float, int, int, int]] = []
    for size in {c[1] for c in counts if not c[0]}:
        null = [(step, n) for control, s, step, n in counts if control and s == size]
        total = sum(n for _, n in null)
        for control, s, step, n in counts:
            if not control and s == size:
                as_random = sum(m for other, m in null if other <= step)
                tested.append(((1 + as_random) / (1 + total), size, step, n))
    tested.sort()
    everything = sum(t[3] for t in tested)
    seen, greatest = 0, -1.0
    for i, (p, _, _, n) in enumerate(tested):
        seen += n
        if i + 1 < len(tested) and tested[i + 1][0] == p:
            continue
        if p <= FALSE_DISCOVERIES * seen / everything:
            greatest = p
    limits: dict[int, int] = {}
    for p, size, step, _ in tested:
        if p <= greatest:
            limits[size] = max(limits.get(size, -1), step)
    return limits


def find_spans(text: str | None, limits: dict[int, int]) -> list[Span]:
    """Base spans, and the candidates that look random enough for their length."""
    if not text:
        return []
    base = base_spans(text)
    random: list[Span] = []
    # Of parts that lie in each other the longest; it comes first of those that begin alike.
    for start, end, size, step in sorted(candidates(text, base), key=lambda c: (c[0], -c[1])):
        if step <= limits.get(size, -1) and not (random and end <= random[-1][2]):
            random.append(("random", start, end))
    return ordered(base + random) if random else base


def secret_spans(limits: dict[int, int], text: Column) -> Column:
    """array<struct<kind, start, end>>, code points, end exclusive, by start and kind."""
    kind = T.ArrayType(
        T.StructType(
            [
                T.StructField("kind", T.StringType()),
                T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType()),
            ]
        )
    )
    arrow = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    )

    def spans(texts: pa.Array) -> pa.Array:
        found = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, limits)]
            for t in texts.to_pylist()
        ]
        return pa.array(found, arrow)

    def run(texts: pa.Array) -> pa.Array:
        return by_blocks(spans, texts, arrow)

    return F.arrow_udf(run, kind)(text)


def redacted(limits: dict[int, int], text: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``[SECRET]``; null stays null."""

    def rewritten(texts: pa.Array) -> pa.Array:
        out, changed = [], False
        for text in texts.to_pylist():
            spans = find_spans(text, limits)
            if spans:
                changed = True
                parts, at = [], 0
                for _, start, end in spans:
                    if start >= at:
                        parts += [text[at:start], "[SECRET]"]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string()) if changed else texts

    def run(texts: pa.Array) -> pa.Array:
        return by_blocks(rewritten, texts, pa.string())

    return F.arrow_udf(run, T.StringType())(text)


def scan_secrets(docs: DataFrame, limits: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, spans) of every document."""
    if limits is None:
        limits = fit_thresholds(docs)
    return docs.select("doc_id", secret_spans(limits, F.col("text")).alias("spans"))


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts of base kinds, a hash of the base spans, and all spans as one string."""
    spelled = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.array_join(F.transform(base, spelled), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", spelled), ",").alias("spans"),
    )
