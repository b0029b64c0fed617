"""Collocations by multikey three-way quicksort of suffix pointers.

Every place of a text, inside its piece (a stretch between punctuation marks), begins a
suffix of which ``LONGEST`` words count. Sorting the suffixes word by word brings equal
phrases together, and the size of an equal partition is the count of a phrase.

1. Routing tables. Each task counts its leading words, word pairs, triples and fours in
   tables of hashed slots; summed, they come to the driver as bits. The sieve tells which
   leading pairs may reach ``least`` occurrences (a slot's sum is never below the true
   count): other suffixes are abandoned before anything is shuffled. The route tells which
   leading words are so frequent that one task should not have all of their suffixes.
2. Suffixes go to partitions by their leading pair; those of a heavy pair by three leading
   words, of a heavy triple by four, and so on. Equal suffixes of a block are one line with
   a count, so a passage that a third of all documents share costs a line a block. A
   block's lines for a partition travel sorted, as one compressed row.
3. Each partition is sorted by multikey three-way quicksort over pointers: a pivot word
   parts the pointers into less, equal and greater; equal ones go on with the next word. A
   partition that weighs less than ``least`` is abandoned at once. The count of a heavy
   prefix is spread over partitions, so each reports its share and the shares are added.
4. The phrases found are a small table. Parts' counts are joined to every cut, phrases
   that a longer one covers are dropped, the rest are ranked.

The sieve has a fixed size (``SLOTS``), so that what tasks send grows with their number
alone. On larger inputs it tells less apart, as fewer pairs are rare there, and more
suffixes are shuffled: at most a line for each distinct suffix of a block. Counts don't
depend on it. Phrases are compared as strings, not as fingerprints, but for the merging of
equal suffixes in a block (64 bits).

Edge cases: null and empty texts have no words; a null language counts as ``und``; texts
longer than a block are cut between pieces, so any length goes; repeated rows count again
each time; ties are ordered by count and phrase; an empty table gives no rows; extra columns
are not read. A phrase of fewer words than ``LONGEST`` ends with its piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.llm.common import scratch
from tidewell.llm.ngram_join import mixed
from tidewell.workspace import Workspace

# Fixed values of the contract: words of a phrase at most, occurrences at least, rows of a language.
LONGEST, LEAST, KEEP = 5, 100, 2000

# Text bytes whose suffixes a task holds at a time, unless one piece is longer.
BLOCK_BYTES = 8 << 20

# Slots of the sieve, for pairs; words have a quarter as many.
SLOTS = 1 << 21

# Occurrences from which a leading phrase is heavy; slots of the route tables at most.
HEAVY, MOST_ROUTES = 500_000, 1 << 20

# Text bytes whose suffixes one partition sorts, about.
PARTITION_BYTES = 24 << 20

# Languages whose word totals may be broadcast.
BROADCAST_LANGUAGES = 10_000

# Bytes of a table that travel as one row.
_SLICE = 1 << 16

# Capital letters, tabs and piece marks, and what each becomes.
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ........."
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROUTE_DEPTHS = (2, 3, 4)
_FIELDS = ["lang", "phrase", "words", "exact", "n"]

SUFFIXES = "part int, lang string, lines binary"
COUNTS = "lang string, phrase binary, words int, n long"


class _Numbers(dict):
    """A number for each word; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """The words of some texts as numbers, 0 between pieces, and hashes of leading words."""

    def __init__(self, texts: list[tuple[str, bytes]]) -> None:
        index = _Numbers({b".": 0})
        number = index.__getitem__
        self.languages = sorted({lang for lang, _ in texts})
        code = {lang: i for i, lang in enumerate(self.languages)}
        rows, langs = [np.zeros(1, np.int32)], [np.zeros(1, np.int32)]
        for lang, folded in texts:
            words = folded.replace(b".", b" . ").split()
            rows += [np.fromiter(map(number, words), np.int32, len(words)), rows[0]]
            langs.append(np.full(len(words) + 1, code[lang], np.int32))
        # Breaks at the end, so that every place has LONGEST words after it.
        self.ids = np.concatenate([*rows, np.zeros(LONGEST, np.int32)])
        self.lang = np.concatenate([*langs, np.zeros(LONGEST, np.int32)])
        self.vocabulary = list(index)
        hashes = np.fromiter(map(zlib.crc32, self.vocabulary), np.uint64, len(index))
        self.word_hash = mixed((hashes + np.uint64(1)) * _ODD)
        lang_hash = [zlib.crc32(lang.encode("utf-8")) for lang in self.languages]
        self.seed = mixed((np.array(lang_hash, np.uint64) + np.uint64(7)) * _ODD)

    def leading(self, places: np.ndarray, words: int) -> np.ndarray:
        """A hash of the language and the first ``words`` words at each place."""
        value = self.seed[self.lang[places]]
        for i in range(words):
            value = mixed((value ^ self.word_hash[self.ids[places + i]]) * _ODD)
        return value

    def places(self, words: int) -> np.ndarray:
        """Places with so many words before the next break."""
        real = self.ids > 0
        fit = real[: len(real) - LONGEST].copy()
        for i in range(1, words):
            fit &= real[i : i + len(fit)]
        return np.flatnonzero(fit)


def _cut(folded: bytes, most: int) -> Iterator[bytes]:
    """Stretches of whole pieces, of ``most`` bytes each unless one piece is longer."""
    at = 0
    while len(folded) - at > most:
        end = folded.rfind(b".", at, at + most) + 1 or folded.find(b".", at + most) + 1
        if not end:
            break
        yield folded[at:end]
        at = end
    yield folded[at:]


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of the texts of batches of (lang, text), folded to small letters and marks."""
    waiting: list[tuple[str, bytes]] = []
    size = 0
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for row in range(batch.num_rows):
            text = texts[row].as_py()
            if not text:
                continue
            for part in _cut(text.encode("utf-8").translate(_FOLD), most):
                waiting.append((langs[row].as_py(), part))
                size += len(part)
                if size >= most:
                    yield Block(waiting)
                    waiting, size = [], 0
    if waiting:
        yield Block(waiting)


class Tables:
    """Which leading words may be frequent and which are heavy, as bits by hashed slot."""

    def __init__(self, slots: int, routes: int) -> None:
        self.sizes = {"word": slots // 4, "pair": slots} | {str(d): routes for d in _ROUTE_DEPTHS}
        self.bits: dict[str, np.ndarray] = {}

    def slots(self, name: str, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(20) & np.uint64(self.sizes[name] - 1)).astype(np.int64)

    def has(self, name: str, hashes: np.ndarray) -> np.ndarray:
        slots = self.slots(name, hashes)
        return (self.bits[name][slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
        """The counts of one task: up to 255 in the sieve, which is all it needs."""
        sums = {name: np.zeros(size, np.uint32) for name, size in self.sizes.items()}
        for block in blocks(batches):
            for name, words in (("word", 1), ("pair", 2), *((str(d), d) for d in _ROUTE_DEPTHS)):
                hashes = block.leading(block.places(words), words)
                found = np.bincount(self.slots(name, hashes), minlength=self.sizes[name])
                sums[name] += found.astype(np.uint32)
        for name, values in sums.items():
            yield name, np.minimum(values, 255).astype(np.uint8) if name in ("word", "pair") else values


def _sized(total: int, least: int, most: int) -> int:
    """The power of two from ``total`` on, within bounds."""
    return min(max(least, 1 << max(0, int(total) - 1).bit_length()), most)


def count_tables(docs: DataFrame, text_bytes: int, partitions: int, least: int) -> Tables:
    """The routing tables of (lang, text) rows.

    A task sends each table in slices; slices are added as they stream in, so no task
    holds more than its share of one table. The driver gets the bits alone.
    """
    heavy = max(HEAVY, 2 * text_bytes // MOST_ROUTES)
    tables = Tables(SLOTS, _sized(2 * text_bytes // heavy, 1 << 12, MOST_ROUTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, values in tables.count(batches):
            raw = values.tobytes()
            for at in range(0, len(raw), _SLICE):
                part = raw[at : at + _SLICE]
                if part.count(0) < len(part):
                    packed = zlib.compress(part, 1)
                    columns = [pa.array([name]), pa.array([at // _SLICE]), pa.array([packed])]
                    yield pa.RecordBatch.from_arrays(columns, ["name", "slice", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kind = np.uint8 if name in ("word", "pair") else np.uint32
                values = np.frombuffer(zlib.decompress(raw), kind).astype(np.int64)
                old = sums.get((name, part))
                sums[name, part] = values if old is None else np.add(old, values, out=old)
        for (name, part), values in sums.items():
            limit = least if name in ("word", "pair") else heavy
            bits = np.packbits(values >= limit, bitorder="little").tobytes()
            columns = [pa.array([name]), pa.array([part]), pa.array([bits])]
            yield pa.RecordBatch.from_arrays(columns, ["name", "slice", "data"])

    kind = "name string, slice long, data binary"
    found = (
        docs.mapInArrow(count, kind)
        .repartition(max(1, min(partitions, 64)), "name", "slice")
        .mapInArrow(add, kind)
    )
    for name, size in tables.sizes.items():
        tables.bits[name] = np.zeros(size // 8, np.uint8)
    for name, part, data in found.collect():
        bits = np.frombuffer(bytes(data), np.uint8)
        at = part * len(bits)
        tables.bits[name][at : at + len(bits)] = bits
    return tables


def _suffix_rows(block: Block, tables: Tables, partitions: int) -> pa.RecordBatch:
    """Lines (phrase, count, exact) for each partition and language, packed.

    Lines are the suffixes whose leading pair may be frequent, frequent words, and, as the
    phrase ``.``, the number of words. A suffix ends where a pair is met that can't be
    frequent. ``exact`` is the number of leading words from which on all equal suffixes
    go to one partition.
    """
    places = block.places(2)
    pairs = np.zeros(len(block.ids) + LONGEST, bool)
    pairs[places] = tables.has("pair", block.leading(places, 2))
    starts = np.flatnonzero(pairs)
    depth = np.full(len(starts), 2, np.int64)
    going = np.ones(len(starts), bool)
    for i in range(1, LONGEST - 1):
        going &= pairs[starts + i]
        depth += going
    whole = np.zeros(len(starts), np.uint64)
    for words in range(2, LONGEST + 1):
        own = depth == words
        whole[own] = mixed(block.leading(starts[own], words) ^ np.uint64(words))
    order = np.argsort(whole, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))
    if not len(order):
        first = np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(order)))
    starts, depth, whole = starts[order[first]], depth[order[first]], whole[order[first]]
    route, exact = whole.copy(), depth + 1
    exact[depth == LONGEST] = LONGEST
    still = np.ones(len(starts), bool)
    for words in _ROUTE_DEPTHS:
        still &= depth >= words
        hashes = block.leading(starts[still], words)
        light = ~tables.has(str(words), hashes)
        settled = np.flatnonzero(still)[light]
        route[settled], exact[settled] = hashes[light], words
        still[settled] = False
    ones = block.places(1)
    hashes = block.leading(ones, 1)
    kept = tables.has("word", hashes)
    size = np.int64(len(block.vocabulary))
    keys, total = np.unique(
        block.lang[ones[kept]].astype(np.int64) * size + block.ids[ones[kept]], return_counts=True
    )
    word, word_lang = keys % size, keys // size
    word_route = mixed(block.seed[word_lang] ^ block.word_hash[word])
    n = np.bincount(block.lang[ones], minlength=len(block.languages))

    none = np.zeros(len(n), np.int64)
    words = [np.concatenate([block.ids[starts + i] * (depth > i), 0 * word, none]) for i in range(LONGEST)]
    words[0][len(starts) :][: len(word)] = word
    langs = np.concatenate([block.lang[starts], word_lang, np.arange(len(n))])
    counts = np.concatenate([counts, total, n])
    exact = np.concatenate([exact, np.ones(len(word), np.int64), none])
    part = np.concatenate([route, word_route, block.seed]) % np.uint64(partitions)
    order = np.lexsort((*words[::-1], langs, part))
    return _packed(block, part[order], langs[order], [w[order] for w in words], counts[order], exact[order])


def _packed(
    block: Block, part: np.ndarray, langs: np.ndarray, words: list[np.ndarray], counts: np.ndarray, exact: np.ndarray
) -> pa.RecordBatch:
    """Sorted lines, joined and compressed for each partition and language."""
    vocabulary = pa.array(block.vocabulary, pa.binary())
    # The first word is never left out: a total's is the mark that stands for breaks.
    columns = [vocabulary.take(pa.array(ids, mask=(ids == 0) & (i > 0))) for i, ids in enumerate(words)]
    space, tab = (pa.scalar(mark, pa.binary()) for mark in (b" ", b"\t"))
    phrases = pc.binary_join_element_wise(*columns, space, null_handling="skip")
    numbers = [pa.array(x).cast(pa.string()).cast(pa.binary()) for x in (counts, exact)]
    lines = pc.binary_join_element_wise(phrases, *numbers, tab)
    edges = np.flatnonzero(np.diff(part, prepend=part[:1]) | np.diff(langs, prepend=langs[:1]).astype(bool))
    edges = np.concatenate([[0], edges]) if len(part) else edges
    ends = pa.array(np.append(edges, len(part)).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, lines), b"\n")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[edges].astype(np.int32)),
            pa.array(block.languages, pa.string()).take(pa.array(langs[edges])),
            pa.array([zlib.compress(text, 1) for text in joined.to_pylist()], pa.binary()),
        ],
        ["part", "lang", "lines"],
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    """(lang, phrase, words, exact, n) of packed lines."""
    parts = []
    for batch in batches:
        for lang, packed in zip(batch["lang"].to_pylist(), batch["lines"].to_pylist()):
            lines = pa.array(zlib.decompress(packed).split(b"\n"), pa.binary())
            fields = pc.split_pattern(lines, b"\t").flatten()
            n, exact = (
                fields.take(pa.array(np.arange(i, len(fields), 3))).cast(pa.string()).cast(pa.int64())
                for i in (1, 2)
            )
            phrase = fields.take(pa.array(np.arange(0, len(fields), 3)))
            words = pc.add(pc.count_substring(phrase, b" "), 1).cast(pa.int32())
            words = pc.if_else(pc.equal(phrase, pa.scalar(b".", pa.binary())), pa.scalar(0, pa.int32()), words)
            parts.append(pa.table([pa.repeat(lang, len(phrase)), phrase, words, exact, n], _FIELDS))
    return pa.concat_tables(parts).combine_chunks() if parts else pa.table([[]] * 5, _FIELDS)


def frequent_prefixes(
    keys: list[np.ndarray], weight: np.ndarray, exact: np.ndarray, least: int
) -> Iterator[tuple[int, int, int]]:
    """(pointer, words, count) of every phrase that leads suffixes of ``least`` in weight.

    Multikey three-way quicksort over pointers. ``keys`` are the suffixes' language and
    then their words as numbers, 0 behind the last. A phrase of fewer words than its
    suffixes are ``exact`` from is yielded with whatever share of its count is here.
    """

    def wanted(pointers: np.ndarray, depth: int) -> bool:
        return bool(weight[pointers].sum() >= least or (exact[pointers] > depth).any())

    waiting = [(np.arange(len(weight)), 0)]
    while waiting:
        pointers, depth = waiting.pop()
        key = keys[depth][pointers]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        equal = key == pivot
        for part in (pointers[key < pivot], pointers[key > pivot]):
            if len(part) and wanted(part, depth):
                waiting.append((part, depth))
        part = pointers[equal]
        if depth and not pivot:
            continue
        if depth > 1:
            count = int(weight[part].sum())
            if count < least and exact[part[0]] <= depth:
                continue
            yield int(part[0]), depth, count
        if depth < LONGEST and wanted(part, depth + 1):
            waiting.append((part, depth + 1))


def _sorted_counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases, words and totals of one partition."""
    rows = _unpacked(batches)
    if not rows.num_rows:
        return
    short = rows.filter(pc.less(rows["words"], 2))
    if short.num_rows:
        short = short.group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")])
        short = short.filter(pc.or_(pc.equal(short["words"], 0), pc.greater_equal(short["n_sum"], least)))
        short = short.select(["lang", "phrase", "words", "n_sum"])
        yield from short.rename_columns(["lang", "phrase", "words", "n"]).to_batches()
    rows = rows.filter(pc.greater_equal(rows["words"], 2)).combine_chunks()
    if not rows.num_rows:
        return
    phrases = rows["phrase"].combine_chunks()
    depth = rows["words"].to_numpy().astype(np.int64)
    coded = pc.split_pattern(phrases, b" ").flatten().dictionary_encode().indices.to_numpy()
    ends = np.cumsum(depth)
    keys = [rows["lang"].combine_chunks().dictionary_encode().indices.to_numpy()]
    for i in range(LONGEST):
        word = np.zeros(len(depth), np.int32)
        word[depth > i] = coded[(ends - depth)[depth > i] + i] + 1
        keys.append(word)
    del coded
    exact = rows["exact"].to_numpy()
    found = list(frequent_prefixes(keys, rows["n"].to_numpy(), exact, least))
    for at in range(0, len(found), 10_000):
        pointers, words, counts = zip(*found[at : at + 10_000])
        whole = phrases.take(pa.array(pointers)).to_pylist()
        leading = [b" ".join(p.split(b" ")[:k]) for p, k in zip(whole, words)]
        yield pa.RecordBatch.from_arrays(
            [
                rows["lang"].take(pa.array(pointers)).combine_chunks(),
                pa.array(leading, pa.binary()),
                pa.array(words, pa.int32()),
                pa.array(counts, pa.int64()),
            ],
            ["lang", "phrase", "words", "n"],
        )


def phrase_counts(docs: DataFrame, workspace: Workspace, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): phrases and words of ``least`` occurrences; totals as words = 0."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(1, -(-size // PARTITION_BYTES))
    tables = count_tables(rows, size, partitions, least)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield _suffix_rows(block, tables, partitions)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sorted_counts(batches, least)

    packed = rows.mapInArrow(suffixes, SUFFIXES)
    shares = packed.repartitionById(partitions, "part").mapInArrow(sort, COUNTS)
    whole = (
        shares.groupBy("lang", "phrase", "words")
        .agg(F.sum("n").alias("n"))
        .where((F.col("words") == 0) | (F.col("n") >= least))
        .withColumn("phrase", F.col("phrase").cast("string"))
    )
    return workspace.stage(whole, "counts")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _not_covered(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one of the same count contains.

    A longer phrase with as great a count exists only if one of one word more does.
    """
    words = F.split("phrase", " ")
    inner = F.array(
        _part(words, F.lit(1), F.col("words") - 1), _part(words, F.lit(2), F.col("words") - 1)
    )
    covers = (
        phrases.where("words > 2")
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("covering"))
    )
    joined = phrases.join(covers, ["lang", "phrase"], "left")
    return joined.where(F.coalesce("covering", F.lit(0)) < F.col("a")).drop("covering")


def collocations(
    docs: DataFrame, least: int = LEAST, keep: int = KEEP, workspace: Workspace | None = None
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's strongest phrases.

    ``a`` is the phrase's count; ``l`` and ``r`` are those of its parts at the cut of the
    lowest score, floor(1000 * a * n / (l * r)) with n words in the language. Products are
    exact decimals of 38 digits.
    """
    workspace = workspace or scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, workspace, least)
    totals = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    if totals.count() <= BROADCAST_LANGUAGES:
        totals = F.broadcast(totals)
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    cuts = (
        _not_covered(phrases)
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("first", _part(words, F.lit(1), F.col("cut")))
        .withColumn("rest", _part(words, F.col("cut") + 1, F.col("words") - F.col("cut")))
    )
    parts = counts.where("words > 0")
    first = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
    above = "cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(total as decimal(16,0))"
    below = "cast(l as decimal(16,0)) * cast(r as decimal(16,0))"
    best = (
        scored.withColumn("score", F.expr(f"({above}) div ({below})"))
        .groupBy("lang", "phrase", "a", F.col("total").alias("n"))
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"
    )
