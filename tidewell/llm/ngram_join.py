"""Similarity self-join of documents on word 5-grams by rare-first prefix filtering.

A document is the set of its distinct shingles. Two sets can only have a Jaccard
similarity of 0.8 or more if they share a shingle among the first fifth of each in
one common order. The order is rarest first, by counts over the whole corpus in a
table of fixed size (any order common to all is right, only speed depends on it).

1. Count shingles into the table.
2. Write every set's prefix postings. Documents with equal sets are one class,
   represented by its least document.
3. Keep postings whose shingle several sets share, at places and with sizes that the
   positional filter allows some pair.
4. Candidates: in each shingle's group, every set with the group's hub. What the
   length, positional and sketch filters leave is verified once each, by the suffix
   filter and then exactly; links give components.
5. A group whose sets are all in one component needs no more. In the others, pairs of
   different components are candidates, again filtered, verified once, and joined in.

Every pair that the result depends on is verified or ruled out by a bound, so the
components are those of the full link graph. No step lists all pairs of a group:
copies are one class, and near copies meet their group's hub only, unless that leaves
them apart.

Edge cases: texts that are null, empty or without words have an empty set and link
with nothing; with fewer than five words the whole sequence is the only shingle;
rows that repeat a doc_id count as one document each; a null doc_id is linked by its text
like any other, and its component is that of the least id linked with it, null if there
is none; texts of any length are read whole; an empty table gives no rows; columns other
than doc_id and text are not read. The order of equally rare shingles is that of their
hashes and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import BLOCK_BYTES, giving_back, row_blocks, scratch, text_bytes
from tidewell.llm.components import components
from tidewell.workspace import Workspace

# Fixed values of the contract: words in a shingle, least similarity in percent.
WORDS, PERCENT = 5, 80

# Binary digits of the count table's size, and entries of one row of it while it is summed.
COUNTED_BITS, ROW = 20, 1 << 12
COUNTED = 1 << COUNTED_BITS

# Binary digits of the sieve's size in bits, and 64-bit words of one row of it. It is
# broadcast (8 MiB); where it fills up, more postings pass it.
SIEVE_BITS, SIEVE_ROW = 26, 1 << 12

# Bits of a set's sketch, a power of two.
SKETCH_BITS = 512

# Pairs of two longs that may be broadcast.
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 59)) * 8 + 5
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts; keeps its tables of powers."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _word_hashes(self, small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(small)
        if len(self.up) <= n:
            self.up = _powers(_BASE, max(n, BLOCK_BYTES))
            self.down = _powers(pow(_BASE, -1, 1 << 64), max(n, BLOCK_BYTES))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[small] * self.up[:n], out=sums[1:])
        codes = (sums[ends] - sums[starts]) * self.down[starts]
        return mixed(codes + (ends - starts).astype(np.uint64) * _STEP)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the distinct shingles, by text and hash."""
        small = _SMALL[data]
        inside = ~((small == 32) | ((small >= 9) & (small <= 13)))
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        cut = bounds[(bounds > 0) & (bounds < len(data))]
        fresh[cut] = inside[cut]
        starts = np.flatnonzero(fresh)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        stops = np.append(np.flatnonzero(~inside), len(data))
        ends = np.minimum(stops[np.searchsorted(stops, starts)], np.append(starts[1:], len(data)))
        text = np.searchsorted(bounds, starts, side="right") - 1
        words = self._word_hashes(small, starts, ends)
        total = np.bincount(text, minlength=len(bounds) - 1)
        texts, hashes = [], []
        for length in range(1, WORDS + 1):
            last = len(words) - length + 1
            if last <= 0:
                break
            code = words[:last]
            for place in range(1, length):
                code = code * _STEP + words[place : place + last]
            if length < WORDS:
                good = np.flatnonzero(
                    (total[text[:last]] == length) & (text[:last] == text[length - 1 :])
                )
            else:
                good = np.flatnonzero(text[:last] == text[length - 1 :])
            texts.append(text[good])
            hashes.append(mixed(code[good] + np.uint64(length)))
        text, code = np.concatenate(texts), np.concatenate(hashes)
        order = np.lexsort((code, text))
        text, code = text[order], code[order]
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
        return text[keep], code[keep]


def _each_block(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, bounds = text_bytes(batch.column(column))
    for first, last in row_blocks(bounds):
        own = bounds[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]


def count_shingles(docs: DataFrame) -> np.ndarray:
    """How many (document, shingle) pairs fall into each entry of the table, over all documents."""
    schema = "part int, counts array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, table = Shingler(), np.zeros(COUNTED, np.int64)
        for batch in batches:
            for _, _, data, bounds in _each_block(batch, 0):
                _, code = shingles(data, bounds)
                np.add.at(table, _entry(code), 1)
        rows = table.reshape(-1, ROW)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows), dtype=np.int32)), _lists(rows)],
            ["part", "counts"],
        )

    def add(rows: pa.Table) -> pa.Table:
        counts = rows["counts"].combine_chunks().flatten().to_numpy().reshape(-1, ROW)
        summed = _lists(counts.sum(axis=0, keepdims=True))
        return pa.table({"part": rows["part"].slice(0, 1), "counts": summed})

    summed = docs.select("text").mapInArrow(giving_back(count), schema).groupBy("part").applyInArrow(add, schema)
    table = np.zeros(COUNTED, np.int64).reshape(-1, ROW)
    for part, counts in summed.collect():
        table[part] = counts
    return table.ravel()


def _lists(rows: np.ndarray) -> pa.ListArray:
    """Each row of a matrix of 64-bit numbers as a list."""
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel().view(np.int64)))


def _entry(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)


def _sketches(code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each of ``rows`` sets the parity of its elements in every bucket, as 64-bit numbers.

    Two sets' sketches differ in at most as many bits as elements are in one set only.
    """
    bucket = (code >> np.uint64(32)).astype(np.int64) & (SKETCH_BITS - 1)
    odd = np.bincount(row * SKETCH_BITS + bucket, minlength=rows * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, SKETCH_BITS), axis=1).view(np.int64)


def least_overlap(n: int) -> int:
    """Fewest shingles that a set of ``n`` shares with any set it links with."""
    return -(-PERCENT * n // 100)


def describe_sets(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, n, set_1, set_2, sketch, prefix) of every document.

    ``set_1`` and ``set_2`` are a 128-bit fingerprint of the set. ``prefix`` has the
    rarest shingles, rarest first; it is null for empty sets and, within a batch,
    for all but the first document with an equal set.
    """
    schema = "doc_id long, n long, set_1 long, set_2 long, sketch array<long>, prefix array<long>"
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(), shared.value
        for batch in batches:
            met: set[tuple[int, int, int]] = set()
            for first, last, data, bounds in _each_block(batch, 1):
                text, code = shingles(data, bounds)
                edges = np.searchsorted(text, np.arange(last - first + 1))
                again = mixed(code ^ _STEP)
                one = np.zeros(len(code) + 1, np.uint64)
                two = one.copy()
                np.cumsum(mixed(code), out=one[1:])
                np.cumsum(again, out=two[1:])
                one, two = np.diff(one[edges]).view(np.int64), np.diff(two[edges]).view(np.int64)
                size = np.diff(edges)
                common = counts[_entry(code)]
                prefixes: list[np.ndarray | None] = []
                for row in range(last - first):
                    key = (int(size[row]), int(one[row]), int(two[row]))
                    if not key[0] or key in met:
                        prefixes.append(None)
                        continue
                    met.add(key)
                    a, b = edges[row], edges[row + 1]
                    order = np.lexsort((code[a:b], common[a:b]))
                    taken = order[: key[0] - least_overlap(key[0]) + 1]
                    prefixes.append(code[a:b][taken].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(size.astype(np.int64)),
                        pa.array(one),
                        pa.array(two),
                        _lists(_sketches(again, text, last - first)),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "set_1", "set_2", "sketch", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), schema)


def _may_link(n_a: str, place_a: str, n_b: str, place_b: str) -> str:
    """SQL of the length and positional filters of a match at two places.

    What two sets have in common from a match on is in the shorter rest. The first match
    of a pair bounds all they share, and a later one never passes where the first fails;
    so the filter holds match by match. It implies the length filter.
    """
    rest = f"least({n_a} - {place_a}, {n_b} - {place_b})"
    return f"{100 + PERCENT} * {rest} >= {PERCENT} * ({n_a} + {n_b})"


def sieve(shingles: DataFrame) -> np.ndarray:
    """Bits of a table of fixed size in which each of the ``shingles`` sets one."""
    place = f"shiftrightunsigned(shingle, {64 - SIEVE_BITS})"
    words = shingles.selectExpr(
        f"shiftright({place}, 6) word", f"shiftleft(1L, cast({place} & 63 as int)) bits"
    )
    words = words.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    schema = "part long, bits array<long>"

    def pack(rows: pa.Table) -> pa.Table:
        row = np.zeros((1, SIEVE_ROW), np.int64)
        row[0, rows["word"].to_numpy() % SIEVE_ROW] = rows["bits"].to_numpy()
        return pa.table({"part": rows["part"].slice(0, 1), "bits": _lists(row)})

    packed = words.withColumn("part", F.expr(f"word div {SIEVE_ROW}"))
    table = np.zeros((max(1, (1 << SIEVE_BITS) // 64 // SIEVE_ROW), SIEVE_ROW), np.int64)
    for part, bits in packed.groupBy("part").applyInArrow(pack, schema).collect():
        table[part] = bits
    return table.ravel().view(np.uint64)


def sifted_postings(described: DataFrame, bits: np.ndarray) -> DataFrame:
    """(n, id, shingle, place) of the prefix shingles that the sieve lets pass."""
    shared = described.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            shingle = lists.flatten().to_numpy()
            at = shingle.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
            passed = np.flatnonzero((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            row = np.repeat(np.arange(len(sizes)), sizes)[passed]
            place = passed - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(shingle[passed]),
                    pa.array(place.astype(np.int32)),
                ],
                ["n", "id", "shingle", "place"],
            )

    sets = described.where("prefix is not null").select("n", F.col("set_1").alias("id"), "prefix")
    return sets.mapInArrow(giving_back(run), "n long, id long, shingle long, place int")


def shared_postings(described: DataFrame, workspace: Workspace) -> DataFrame:
    """(shingle, id, n, place) of prefix shingles that several postings have.

    The id is the first half of the set's fingerprint. Most shingles have one posting
    and take no further part. Nor do those of two that the positional filter rules out,
    and single postings whose own rest is too short for even the smallest set of the
    group. What stays is written, which leaves the joins free to split a shingle that
    very many sets share.
    """
    postings = described.where("prefix is not null").select("n", F.posexplode("prefix").alias("place", "shingle"))
    spot = F.expr("shiftleft(n, 32) + place")
    groups = postings.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("sets"), F.min(spot).alias("low"), F.max(spot).alias("high")
    )
    both = _may_link("shiftright(low, 32)", "(low & 4294967295)", "shiftright(high, 32)", "(high & 4294967295)")
    groups = groups.where(f"sets > 2 or sets = 2 and {both}")
    several = workspace.stage(groups.selectExpr("shingle", "shiftright(low, 32) least_n"), "several")
    kept = sifted_postings(described, sieve(several)).join(several, "shingle")
    kept = kept.where(f"{100 + PERCENT} * (n - place) >= {PERCENT} * (n + least_n)")
    return kept.select("shingle", "id", "n", "place")


def hub_candidates(postings: DataFrame, workspace: Workspace) -> DataFrame:
    """Every set of a shingle's group with the group's hub.

    The hub is the set in which the shingle comes first: of near copies the one with
    fewest rarer shingles of its own, so the one most like all others.
    """
    hubs = postings.groupBy("shingle").agg(
        F.min(F.struct("place", "id", "n")).alias("hub"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
    )
    hubs = workspace.stage(hubs.where("low < high").select("shingle", "hub"), "hubs")
    matches = postings.join(hubs, "shingle").where("id <> hub.id")
    matches = matches.where(_may_link("n", "place", "hub.n", "hub.place"))
    return matches.selectExpr("least(id, hub.id) a", "greatest(id, hub.id) b").distinct()


def open_candidates(postings: DataFrame, parts: DataFrame, workspace: Workspace) -> DataFrame:
    """Pairs of a shingle's group that are in different components, where there are any."""
    placed = postings.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    mixed_groups = (
        placed.groupBy("shingle")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("shingle")
    )
    rest = placed.join(workspace.stage(mixed_groups, "mixed"), "shingle").distinct()
    rest = workspace.stage(rest, "mixed-postings")
    matches = rest.alias("x").join(
        rest.alias("y"),
        F.expr(
            "x.shingle = y.shingle and x.id < y.id and x.component <> y.component and "
            + _may_link("x.n", "x.place", "y.n", "y.place")
        ),
    )
    return matches.selectExpr("x.id a", "y.id b").distinct()


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link. ``sketches`` is (id, n, sketch)."""
    both = pairs.join(sketches.selectExpr("id a", "n n_a", "sketch sketch_a"), "a").join(
        sketches.selectExpr("id b", "n n_b", "sketch sketch_b"), "b"
    )
    apart = (
        "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    )
    # Sets that link have at least PERCENT of (n_a + n_b - shared) in common.
    return both.where(
        f"{100 + PERCENT} * (n_a + n_b - {apart}) >= {2 * PERCENT} * (n_a + n_b)"
    ).select("a", "b")


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Most that two sorted sets can have in common, by halving both about one value."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    middle = len(a) // 2
    at = int(np.searchsorted(b, a[middle]))
    same = int(at < len(b) and b[at] == a[middle])
    left = suffix_bound(a[:middle], b[:at], depth - 1)
    return left + same + suffix_bound(a[middle + 1 :], b[at + same :], depth - 1)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity, by the suffix filter and exactly."""
    need = PERCENT * (len(a) + len(b))
    if (100 + PERCENT) * suffix_bound(a, b) < need:
        return False
    at = np.searchsorted(b, a).clip(max=len(b) - 1)
    return (100 + PERCENT) * int((b[at] == a).sum()) >= need


def _sets(texts: pa.Array, shingles: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """Sorted sets of all texts, one after the other, and where each begins and ends."""
    text, code = shingles(*text_bytes(texts))
    return code, np.searchsorted(text, np.arange(len(texts) + 1))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. ``texts`` is (id, text), one row an id.

    Texts travel, not sets: a set's hashes are twice as long and don't compress.
    """
    schema = "a long, b long"
    both = (
        pairs.join(texts.selectExpr("id a", "text left_text"), "a")
        .join(texts.selectExpr("id b", "text right_text"), "b")
        .select("a", "b", "left_text", "right_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sizes = text_bytes(batch.column(2))[1] + text_bytes(batch.column(3))[1]
            for first, last in row_blocks(sizes):
                part, rows = batch.slice(first, last - first), last - first
                ids = np.concatenate([part.column(0).to_numpy(), part.column(1).to_numpy()])
                _, one, at = np.unique(ids, return_index=True, return_inverse=True)
                either = pa.concat_arrays([part.column(2), part.column(3)])
                code, edges = _sets(either.take(pa.array(one)), shingles)
                good = [
                    linked(code[edges[a] : edges[a + 1]], code[edges[b] : edges[b + 1]])
                    for a, b in zip(at[:rows], at[rows:])
                ]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(giving_back(run), schema)


def candidate_texts(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of those ``members`` (id, doc_id, again) that are in ``pairs``, once each.

    The members are counted first. Up to ``BROADCAST_ROWS`` of them go to the texts;
    beyond that the texts are shuffled to them. ``again`` tells that several rows have
    the doc_id; of those one with the member's set is taken. Rows without doc_id are found by
    their sets.
    """
    wanted = pairs.selectExpr("explode(array(a, b)) id").distinct().join(members, "id")
    few = wanted.count() <= BROADCAST_ROWS
    side = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(side, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            for first, last in row_blocks(text_bytes(batch.column(1))[1]):
                part = batch.slice(first, last - first)
                code, edges = _sets(part.column(1), shingles)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(code))])
                own = np.diff(sums[edges]).view(np.int64) == part.column(0).to_numpy()
                yield part.filter(pa.array(own))

    once = texts.where("not again").select("id", "text")
    nameless = wanted.where("doc_id is null").select("id")
    if not nameless.isEmpty():
        found = docs.where("doc_id is null").select(set_fingerprint(F.col("text")).alias("own"), "text")
        found = found.select(F.col("own.set_1").alias("id"), "text").join(nameless, "id", "left_semi")
        once = once.union(found.dropDuplicates(["id"]))
    if members.where("again").isEmpty():
        return once
    several = texts.where("again").select("id", "text").mapInArrow(giving_back(run), "id long, text string")
    return once.union(several.dropDuplicates(["id"]))


def set_fingerprint(text: Column) -> Column:
    """struct<n, set_1, set_2> of a text's set: its size and a fingerprint of 128 bits."""

    def run(texts: pa.Array) -> pa.Array:
        shingles, parts = Shingler(), []
        data, bounds = text_bytes(texts)
        for first, last in row_blocks(bounds):
            own = bounds[first : last + 1]
            text, code = shingles(data[own[0] : own[-1]], own - own[0])
            edges = np.searchsorted(text, np.arange(last - first + 1))
            sums = [np.zeros(len(code) + 1, np.uint64) for _ in range(2)]
            np.cumsum(mixed(code), out=sums[0][1:])
            np.cumsum(mixed(code ^ _STEP), out=sums[1][1:])
            columns = [np.diff(edges).astype(np.int64), *(np.diff(x[edges]).view(np.int64) for x in sums)]
            parts.append(pa.StructArray.from_arrays(list(map(pa.array, columns)), ["n", "set_1", "set_2"]))
        kind = pa.struct([(name, pa.int64()) for name in ("n", "set_1", "set_2")])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, "struct<n: bigint, set_1: bigint, set_2: bigint>")(text)


def ngram_components(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    placed = placed_sets(docs, workspace)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def placed_sets(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """(doc_id, n, set_1, set_2, component, component_id) of every document.

    ``set_1`` and ``set_2`` tell sets apart, ``component`` tells components apart, even where
    ids are null or repeat. Empty sets have none of their own.
    """
    workspace = workspace or scratch(docs.sparkSession, "ngrams")
    described = workspace.stage(describe_sets(docs, count_shingles(docs)), "described")
    narrow = described.select("doc_id", "n", "set_1", "set_2")
    classes = workspace.stage(
        narrow.where("n > 0").groupBy("n", "set_1", "set_2").agg(F.min("doc_id").alias("least")),
        "classes",
    )
    postings = workspace.stage(shared_postings(described, workspace), "postings")
    # Sets whose half fingerprints agree by chance share an id; then none of them
    # is told apart by it, and the class with the least document stands for it.
    repeated = narrow.groupBy("doc_id").count().where("count > 1")
    repeated = repeated.select("doc_id", F.lit(True).alias("again"))
    members = classes.groupBy(F.col("set_1").alias("id")).agg(F.min("least").alias("doc_id"))
    members = members.join(repeated, "doc_id", "left").select(
        "id", "doc_id", F.coalesce("again", F.lit(False)).alias("again")
    )
    members = workspace.stage(members, "members")
    sketches = described.where("prefix is not null").select(F.col("set_1").alias("id"), "n", "sketch")
    sketches = workspace.stage(sketches.distinct(), "sketches")
    first = workspace.stage(hub_candidates(postings, workspace), "hub-pairs")
    near = workspace.stage(alike(first, sketches), "hub-alike")
    texts = workspace.stage(candidate_texts(docs, members, near), "hub-texts")
    links = workspace.stage(verified(near, texts), "hub-links")
    parts = components(links, workspace, "hubs")
    rest = open_candidates(postings, parts, workspace).join(first, ["a", "b"], "left_anti")
    rest = workspace.stage(alike(rest, sketches), "open-pairs")
    texts = workspace.stage(candidate_texts(docs, members, rest), "open-texts")
    more = workspace.stage(verified(rest, texts), "open-links")
    joined = components(links.union(more), workspace, "all")
    least = (
        classes.select(F.col("set_1").alias("id"), "least")
        .join(joined.withColumnRenamed("node", "id"), "id")
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
    )
    placed = joined.select(F.col("node").alias("set_1"), "component").join(least, "component")
    named = classes.join(placed, "set_1", "left").select(
        "n",
        "set_1",
        "set_2",
        F.coalesce("component", "set_1").alias("component"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    return narrow.join(named, ["n", "set_1", "set_2"], "left").select(
        "doc_id", "n", "set_1", "set_2", "component",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
