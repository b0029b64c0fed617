"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every place of every document begins a suffix; only the first ``DEPTH`` bytes count.
Most-significant-digit passes split suffixes into groups that agree so far, and a
suffix alone in its group is dropped at once; the groups left after the last digit
are exactly the repeated strings. Digits here are stretches of bytes, told apart by
64-bit fingerprints, so a pass is a shuffle and there are few of them.

1. The first pass lists one suffix for many. Of the ``WINDOW`` places that a string
   begins at or soon after, the one whose bytes hash least is its anchor; equal strings
   have their anchors at equal distance. The anchor's first ``FIRST`` bytes are the first
   digit. An anchor stands for the run of strings that share it, about seventy.
2. Of the anchors left, the whole stretch under their strings is the next digit: where
   a stretch occurs twice, all its strings are repeated, however many copies there are.
3. Where stretches of one first digit differ, one of each is read again and its strings
   go through the remaining digits, four of fifty bytes. A group of few stretches is
   sorted in one task. A group of many is divided further: runs of ``PART`` strings by
   the bytes all of them have, where copies are again told at once, and what is left
   string by string, spread by fingerprint and counted.

No pass needs all of a group in one task, and copies cost one narrow row an anchor.

Edge cases: null and empty texts, and texts shorter than ``DEPTH``, lose nothing;
repeated rows are copies of each other and lose all they have from ``DEPTH`` bytes on;
a string may overlap the other place it occurs at; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewell.llm.common import row_blocks, scratch, text_bytes
from tidewell.llm.ngram_join import mixed
from tidewell.workspace import Workspace

# Fixed value of the contract: bytes in a string.
DEPTH = 200

# Bytes of an anchor's first digit, places among which an anchor is least, bytes of later digits.
FIRST = 64
WINDOW = DEPTH - FIRST + 1
DIGIT = 50

# Different stretches of a first digit that are sorted in one task at most.
FEW = 400

# Strings in a part of a stretch of a larger group.
PART = 16

# Bits of the table that tells which documents a join is about.
MARKED_BITS = 24

_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 59)) * 8 + 5
_MIX = np.uint64(0xD6E8FEB86659FD93)
_INDEX_BITS = 30


class Fingerprints:
    """64-bit fingerprints of stretches of a byte array; keeps its tables of powers."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def over(self, data: np.ndarray) -> Fingerprints:
        n = len(data)
        if len(self.up) <= n:
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                powers = np.full(2 * n + 1, np.uint64(base), np.uint64)
                powers[0] = 1
                both.append(np.multiply.accumulate(powers))
            self.up, self.down = both
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[:n], out=self.sums[1:])
        return self

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first string, strings) of the runs of strings that share an anchor.

    Places count from the beginning of ``data``; strings never cross texts.
    """
    none = (np.zeros(0, np.int64),) * 4
    strings = len(data) - DEPTH + 1
    if strings <= 0:
        return none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.ndarray((len(data),), "<u8", padded.data, 0, (1,))
    keep = np.uint64(_INDEX_BITS)
    value = ((mixed(grams * _MIX) >> keep) << keep) | np.arange(len(data), dtype=np.uint64)
    rows = -(-(len(value) + WINDOW) // WINDOW)
    whole = np.full(rows * WINDOW, np.uint64((1 << 64) - 1), np.uint64)
    whole[: len(value)] = value
    grid = whole.reshape(rows, WINDOW)
    after = np.minimum.accumulate(grid, axis=1).ravel()
    before = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(before[:strings], after[WINDOW - 1 : WINDOW - 1 + strings])
    anchor = (least & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    fresh = np.ones(strings, bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    # A text's first string begins a run; strings that would cross into the next end one.
    last = bounds[1:] - DEPTH
    starts = bounds[:-1][last >= bounds[:-1]]
    fresh[starts] = True
    inside = np.zeros(strings + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(last[last >= bounds[:-1]] + 1, strings), -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = np.flatnonzero(fresh & inside)
    if not len(first):
        return none
    ends = np.flatnonzero(~inside | fresh)
    ends = np.append(ends, strings)
    stop = ends[np.searchsorted(ends, first, side="right")]
    text = np.searchsorted(bounds, first, side="right") - 1
    return text, anchor[first], first, stop - first


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, bounds = text_bytes(batch.column(column))
    for first, last in row_blocks(bounds):
        own = bounds[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, mark): no null key; the mark tells rows apart that share an id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.xxhash64("text").alias("mark"),
    )


# What is told of an anchor in one number, low bits first: how far the anchor is from its
# first string, how many strings share it, and where the first begins.
_STRINGS, _START = "(place >> 8) & 255", "place >> 16"


def anchor_rows(keyed: DataFrame) -> DataFrame:
    """(digit, code, key, mark, place) of every anchor; the code is the stretch's fingerprint."""
    schema = "digit long, code long, key long, mark long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            marks = batch.column("mark").to_numpy()
            for low, _, data, bounds in _blocks(batch, 1):
                text, anchor, first, strings = anchors(data, bounds)
                if not len(first):
                    continue
                own = prints.over(data)
                shift = anchor - first
                code = own.of(first, first + strings - 1 + DEPTH)
                code = mixed(code + (shift * 256 + strings).astype(np.uint64) * _MIX)
                place = ((first - bounds[text]) << 16) | (strings << 8) | shift
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.of(anchor, anchor + FIRST).view(np.int64)),
                        pa.array(code.view(np.int64)),
                        pa.array(keys[low + text]),
                        pa.array(marks[low + text]),
                        pa.array(place),
                    ],
                    ["digit", "code", "key", "mark", "place"],
                )

    return keyed.select("key", "text", "mark").mapInArrow(run, schema)


def _marked_keys(rows: DataFrame) -> np.ndarray:
    """A bit table of fixed size with every key of ``rows`` in it; a bit may stand for several keys.

    It only spares other documents a shuffle: too full a table spares none.
    """
    slot = F.shiftrightunsigned(F.xxhash64("key"), 64 - MARKED_BITS)
    words = (
        rows.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (MARKED_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def _where_marked(keyed: DataFrame, table: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The documents whose key may be in the table, and the others."""
    packed = keyed.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy()
        return pa.array((packed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    slot = F.shiftrightunsigned(F.xxhash64("key"), 64 - MARKED_BITS)
    held = F.arrow_udf(run, T.BooleanType())(slot)
    return keyed.where(held), keyed.where(~held)


def survivors(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the strings that begin at ``starts`` occur twice within their group.

    Most significant digits first; strings alone in their group leave after each.
    """
    prints = Fingerprints().over(data)
    alive = np.arange(len(starts))
    for digit in range(0, DEPTH, DIGIT):
        at = starts[alive] + digit
        value = prints.of(at, at + DIGIT)
        order = np.lexsort((value, group[alive]))
        alive, value = alive[order], value[order]
        own = group[alive]
        fresh = np.ones(len(alive), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
        number = np.cumsum(fresh) - 1
        many = np.bincount(number, minlength=1)[number] > 1
        group = group.copy()
        group[alive] = number
        alive = alive[many]
        if not len(alive):
            break
    out = np.zeros(len(starts), bool)
    out[alive] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def stretches(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(digit, many, hot, key, mark, place, bytes) of the chosen (digit, many, hot, key, mark, place)."""
    schema = "digit long, many boolean, hot boolean, key long, mark long, place long, bytes binary"
    wanted = chosen.groupBy("key", "mark").agg(
        F.collect_list(F.struct("digit", "many", "hot", "place")).alias("list")
    )
    texts = _where_marked(keyed, _marked_keys(chosen))[0]
    joined = texts.join(wanted.hint("shuffle_hash"), ["key", "mark"])
    joined = joined.select("key", "mark", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            lists = batch.column("list")
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            items = lists.flatten()
            place = items.field("place").to_numpy()
            first = bounds[row] + (place >> 16)
            size = ((place >> 8) & 255) + DEPTH - 1
            whole = data.tobytes()
            for at in range(0, len(row), 4096):
                part = slice(at, at + 4096)
                cut = [whole[a : a + n] for a, n in zip(first[part], size[part])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(items.field(c)[part] for c in ("digit", "many", "hot")),
                        *(batch.column(c).take(pa.array(row[part])) for c in ("key", "mark")),
                        items.field("place")[part],
                        pa.array(cut, pa.binary()),
                    ],
                    ["digit", "many", "hot", "key", "mark", "place", "bytes"],
                )

    return joined.mapInArrow(run, schema)


RUNS = "key long, mark long, first long, last long"


def _strings_of(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bytes of all stretches, and of each string: its row, begin, and distance to its anchor."""
    data, bounds = text_bytes(rows["bytes"].cast(pa.large_binary()).combine_chunks())
    place = rows["place"].to_numpy()
    number = (place >> 8) & 255
    row = np.repeat(np.arange(len(place)), number)
    index = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    return data, row, bounds[row] + index, (place & 255)[row] - index, index


def sorted_groups(rows: DataFrame) -> DataFrame:
    """Repeated strings of the stretches of groups of few, as runs (key, mark, first, last)."""

    def done(table: pa.Table) -> pa.RecordBatch:
        data, row, begin, distance, index = _strings_of(table)
        digit = table["digit"].to_numpy()
        group = np.cumsum(np.concatenate([[0], digit[1:] != digit[:-1]]))[row] * 256 + distance
        again = survivors(data, begin, group)
        keys, marks = table["key"].to_numpy(), table["mark"].to_numpy()
        place = table["place"].to_numpy()
        again &= ~table["many"].to_numpy(zero_copy_only=False)[row]
        # A run never goes on from one stretch to the next.
        cut = np.concatenate([[False], row[1:] != row[:-1]])
        spaced = np.insert(again, np.flatnonzero(cut), False)
        origin = np.insert(np.arange(len(again)), np.flatnonzero(cut), -1)
        a, b = _runs(spaced)
        a, b = origin[a], origin[b - 1]
        own = row[a]
        start = place[own] >> 16
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys[own]),
                pa.array(marks[own]),
                pa.array(start + index[a]),
                pa.array(start + index[b]),
            ],
            ["key", "mark", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            digit = table["digit"].to_numpy()
            whole = int(np.searchsorted(digit, digit[-1]))
            held = table.slice(whole)
            if whole:
                yield done(table.slice(0, whole))
        if held is not None:
            yield done(held)

    cold = rows.where("not hot").repartition("digit").sortWithinPartitions("digit")
    return cold.mapInArrow(run, RUNS)


def divided(rows: DataFrame) -> DataFrame:
    """(digit, code, many, key, mark, place, bytes) of the parts of the stretches of groups of many.

    A part is up to ``PART`` strings at fixed distances from the anchor. Its digit is
    the bytes that all of them have, its code the whole of it.
    """
    schema = "digit long, code long, many boolean, key long, mark long, place long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                table = pa.Table.from_batches([batch.slice(at, 1024)])
                if not table.num_rows:
                    continue
                data, row, begin, distance, index = _strings_of(table)
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (distance[1:] // PART != distance[:-1] // PART)
                first = np.flatnonzero(fresh)
                number = np.diff(np.append(first, len(row)))
                start, own = begin[first], prints.over(data)
                # Every string of a part has the bytes from where its last could begin
                # to where its first could end.
                core = start + distance[first] % PART
                digit = own.of(core, core + DEPTH - PART + 1)
                group = table["digit"].to_numpy()[row[first]].view(np.uint64)
                digit = mixed(digit + group * _MIX + (distance[first] // PART).astype(np.uint64))
                end = start + number - 1 + DEPTH
                code = own.of(start, end)
                code = mixed(code + (distance[first] * 256 + number).astype(np.uint64) * _MIX)
                place = table["place"].to_numpy()[row[first]]
                begins = (place >> 16) + index[first]
                place = (begins << 16) | (number << 8) | distance[first]
                take = pa.array(row[first])
                whole = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digit.view(np.int64)),
                        pa.array(code.view(np.int64)),
                        *(table[c].combine_chunks().take(take) for c in ("many", "key", "mark")),
                        pa.array(place),
                        pa.array([whole[a:b] for a, b in zip(start, end)], pa.binary()),
                    ],
                    ["digit", "code", "many", "key", "mark", "place", "bytes"],
                )

    return rows.where("hot").mapInArrow(run, schema)


def divided_runs(read: DataFrame, workspace: Workspace) -> DataFrame:
    """Repeated strings of the stretches of groups of many, as runs."""
    parts = workspace.stage(divided(read), "parts")
    kinds = workspace.stage(
        parts.groupBy("digit", "code").agg(
            F.expr("count(*) > 1 or bool_or(many)").alias("again"),
            F.min(F.struct("key", "mark", "place")).alias("one"),
        ),
        "part-kinds",
    )
    copies = parts.where("not many").join(kinds.where("again"), ["digit", "code"]).selectExpr(
        "key", "mark", f"{_START} first", f"({_START}) + ({_STRINGS}) - 1 last"
    )
    number = kinds.groupBy("digit").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    chosen = workspace.stage(kinds.join(number, "digit"), "part-chosen")
    rest = parts.join(chosen, ["digit", "code"]).where(
        "key = one.key and mark = one.mark and place = one.place"
    )
    strings = spread_strings(rest.select(F.col("again").alias("many"), "key", "mark", "place", "bytes"))
    return copies.union(counted_strings(workspace.stage(strings, "strings")))


def spread_strings(rows: DataFrame) -> DataFrame:
    """(one, two, many, key, mark, place, at) of every string of the rows, by fingerprint."""
    schema = "one long, two long, many boolean, key long, mark long, place long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            for at in range(0, len(batch), 512):
                table = pa.Table.from_batches([batch.slice(at, 512)])
                if not table.num_rows:
                    continue
                data, row, begin, distance, index = _strings_of(table)
                own = prints.over(data)
                half = DEPTH // 2
                one = own.of(begin, begin + half)
                two = own.of(begin + half, begin + DEPTH)
                two = mixed(two + distance.astype(np.uint64) * _MIX)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        *(table[c].combine_chunks().take(take) for c in ("many", "key", "mark", "place")),
                        pa.array(index.astype(np.int32)),
                    ],
                    ["one", "two", "many", "key", "mark", "place", "at"],
                )

    return rows.mapInArrow(run, schema)


def counted_strings(strings: DataFrame) -> DataFrame:
    """Repeated strings among those spread, as runs of one string."""
    again = (
        strings.groupBy("one", "two")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("many").alias("with_copies"))
        .where("n > 1 or with_copies")
        .select("one", "two")
    )
    return (
        strings.where("not many")
        .join(again, ["one", "two"])
        .selectExpr("key", "mark", f"({_START}) + at first", f"({_START}) + at last")
    )


def remove_runs(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents without the bytes under the runs of repeated strings.

    (doc_id, n_bytes, n_removed, n_spans, kept); only documents with runs are shuffled.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    lists = runs.groupBy("key", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    some, others = _where_marked(keyed, _marked_keys(runs))
    joined = some.join(lists.hint("shuffle_hash"), ["key", "mark"], "left").select(
        "doc_id", "text", "runs"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            lists = batch.column("runs")
            at = lists.offsets.to_numpy()
            first = lists.flatten().field("first").to_numpy()
            last = lists.flatten().field("last").to_numpy()
            at = np.concatenate([[0], np.cumsum(np.diff(at) * np.asarray(lists.is_valid()))])
            rows = []
            for i in range(len(batch)):
                text = data[bounds[i] : bounds[i + 1]]
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, first[at[i] : at[i + 1]], 1)
                np.add.at(depth, last[at[i] : at[i + 1]] + DEPTH, -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans = len(_runs(gone)[0])
                rows.append((len(text), int(gone.sum()), spans, text[~gone].tobytes()))
                if len(rows) == 512 or i + 1 == len(batch):
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(i + 1 - len(rows), len(rows)),
                            *(pa.array(c, pa.int64()) for c in columns[:3]),
                            pa.array(columns[3], pa.binary()),
                        ],
                        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                    )
                    rows = []

    untouched = others.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.coalesce("text", F.lit("")).cast("binary").alias("kept"),
    )
    return joined.mapInArrow(run, schema).union(untouched)


def remove_repeats(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document."""
    workspace = workspace or scratch(docs.sparkSession, "suffixes")
    keyed = _keyed(docs)
    every = workspace.stage(anchor_rows(keyed), "anchors")
    # A written side leaves the join free to split a digit that very many anchors share.
    several = workspace.stage(
        every.groupBy("digit").count().where("count > 1").select("digit"), "several"
    )
    left = workspace.stage(every.join(several, "digit"), "first-digit")
    kinds = left.groupBy("digit", "code").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "mark", "place")).alias("one")
    )
    kinds = workspace.stage(kinds, "stretches")
    number = kinds.groupBy("digit").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    chosen = workspace.stage(
        kinds.join(number, "digit").selectExpr(
            "digit", "n > 1 many", f"kinds > {FEW} hot", "one.key key", "one.mark mark", "one.place place"
        ),
        "chosen",
    )
    copies = left.join(kinds.where("n > 1").select("digit", "code"), ["digit", "code"]).selectExpr(
        "key", "mark", f"{_START} first", f"({_START}) + ({_STRINGS}) - 1 last"
    )
    read = workspace.stage(stretches(keyed, chosen), "read")
    runs = copies.union(sorted_groups(read)).union(divided_runs(read, workspace))
    return remove_runs(keyed, workspace.stage(runs, "runs"))


def repeat_digest(removed: DataFrame) -> DataFrame:
    """The counts of every document, and a hash of what is kept."""
    return removed.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
