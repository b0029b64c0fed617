"""Best-fit packing of tokenised documents into sequences, by bin completion.

Texts are tokenised once, in tasks; what is packed are narrow rows (piece, length).
Sequences of a length are interchangeable, so the packing problem is the histogram
of lengths: at most as many entries as a sequence has tokens, however many documents
there are. The driver solves that. A best-fit decreasing packing is the first
incumbent. Branch and bound then takes the largest length left, enumerates the
undominated fillings of the room beside it, uses a filling as often as the counts
allow, and gives up a branch whose waste can no longer beat the incumbent. The
result is a list of patterns with how often each is used, and pieces find their
place by their rank among pieces of their length.

Edge cases: null and empty texts are the closing token alone; longer documents than a
sequence are cut into pieces, however long they are; repeated rows are packed one by one;
pieces of equal length take places in the order of id, piece and hash; an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidewell.llm.common import giving_back, row_blocks, scratch, text_bytes
from tidewell.operators.models import once_per_worker
from tidewell.workspace import Workspace

# Tokens in a sequence, and the token that ends a document.
CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"

# The parts that the vocabulary cuts a Latin-1 word of small letters into, and the
# greatest byte that begins a Latin-1 character.
PARTS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\t-\r \x85\xa0]+"
)
LATIN_LEADS = 0xC3

# Text bytes tokenised at a time, unless one text is longer; parts in a line and lines
# that the tokenizer gets at a time.
TOKEN_BYTES, LINE_WORDS, LINES = 1 << 20, 512, 16

# Words a task remembers, and their bytes; beyond either it starts anew. Nothing is kept
# when the task ends, as the worker goes on with other stages.
KNOWN_WORDS, KNOWN_BYTES = 900_000, 64 << 20

# Branch and bound stops with the incumbent after so many nodes; a node tries so many
# fillings, found in so many steps. Rows ranked in one task at most, about.
NODES, FILLINGS, STEPS = 6000, 3, 300
RANKED_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Index(dict):
    """A word's number; a new word gets the next one and is listed as pending."""

    def __init__(self) -> None:
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.pending.append(word)
        return number


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _small(texts: pa.Array) -> pa.Array:
    """The texts in small letters, where the vocabulary's own folding surely does the same.

    So it is for Latin-1 without what might be the beginning of a special token.
    """
    data, bounds = text_bytes(texts)
    kept = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    kept[np.searchsorted(bounds, np.flatnonzero(data > LATIN_LEADS), side="right") - 1] = True
    if kept.all():
        return texts
    small = pc.utf8_lower(texts)
    return pc.if_else(pa.array(kept), texts, small) if kept.any() else small


class WordTokens:
    """Token ids of whole texts, word by word.

    The vocabulary's tokens never cross white space, so the ids of a text are those
    of its words (as cut at ASCII white space), and a word met before need not be
    tokenised again. Nor do they cross the parts that the vocabulary cuts words into;
    words of Latin-1 are put together from those.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For small letters already cut into parts, with a space between.
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        # In this vocabulary a part's last token, and no other, is marked as such.
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Give up the words met so far; the tokenizer itself stays."""
        self.index = _Index()
        self.bytes = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self) -> None:
        """Tokenise the pending words, the parts of those of Latin-1 many at a time."""
        pending = self.index.pending
        first = len(self.index) - len(pending)
        whole: list[int] = []
        others: list[int] = []
        joined: list[int] = []
        counts: list[int] = []
        parts: list[int] = []
        for number, word in enumerate(pending, first):  # parts of words become pending
            if word.isalpha() and word.isascii() and word.islower():
                whole.append(number)
            elif not _latin(word) or "<|" in word:
                others.append(number)
            else:
                cut = PARTS.findall(word.lower())
                if len(cut) == 1 and cut[0] == word:
                    whole.append(number)
                else:
                    joined.append(number)
                    counts.append(len(cut))
                    parts.extend(map(self.index.__getitem__, cut))
        self.bytes += sum(map(len, pending))
        self.index.pending = []
        while len(self.sizes) < len(self.index):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        for at in range(0, len(whole), LINE_WORDS * LINES):
            some = whole[at : at + LINE_WORDS * LINES]
            lines = [
                " ".join([pending[number - first] for number in some[i : i + LINE_WORDS]])
                for i in range(0, len(some), LINE_WORDS)
            ]
            coded = self.parts.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(encoding.ids, np.int64) for encoding in coded])
            last = np.flatnonzero(self.ends[ids]) + 1
            assert len(last) == len(some) and last[-1] == len(ids)
            self._store(some, ids, last)
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            words = [pending[number - first] for number in some]
            coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            rows = [encoding.ids for encoding in coded]
            ids = np.array([number for row in rows for number in row], np.int64)
            self._store(some, ids, np.cumsum([len(row) for row in rows]))
        if joined:
            ids, ends = self._of(np.array(parts, np.int64))
            self._store(joined, ids, np.append(0, ends)[np.cumsum(counts)])

    def _store(self, numbers: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Keep the ids of some words, that stand one after the other."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        begins = np.append(0, ends[:-1])
        self.starts[numbers], self.sizes[numbers] = self.used + begins, ends - begins
        self.used += len(ids)

    def _of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words, one after the other, and where each word's end."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[which] - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.flat[place], ends

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without the closing token; a null counts as empty."""
        if len(self.index) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self.forget()
        rows = pc.ascii_split_whitespace(_small(texts.fill_null("")))
        words = rows.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False)  # faster than a list
        numbers = np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))
        if self.index.pending:
            self._learn()
        ids, ends = self._of(numbers[words.indices.to_numpy()])
        cuts = np.cumsum(pc.list_value_length(rows).to_numpy())
        return np.split(ids, np.append(0, ends)[cuts[:-1]])


def token_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""

    def make() -> WordTokens:
        if path is not None:
            return WordTokens(path)
        import public_tokenizers

        return WordTokens(public_tokenizers.path(VOCABULARY))

    tokens = once_per_worker(make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in PIECES.split(", ")]
        known = tokens()
        try:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                _, bounds = text_bytes(batch.column(1))
                for first, last in row_blocks(bounds, TOKEN_BYTES):
                    texts = batch.column(1).slice(first, last - first)
                    rows = []
                    for key, ids in zip(keys[first:last], known.encode(texts)):
                        ids = np.append(ids, np.uint32(END)).astype("<u4")
                        for piece, start in enumerate(range(0, len(ids), CAPACITY)):
                            part = ids[start : start + CAPACITY]
                            rows.append((key, piece, start, len(part), zlib.crc32(part.tobytes())))
                    columns = list(zip(*rows))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], names
                    )
        finally:
            known.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), PIECES)


Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over a histogram: (times, ((length, number), ...)) of the bins.

    Bins alike are handled together: a length goes to the bins with the least
    room that holds it, as many to each as fit.
    """
    open_bins: dict[int, list[tuple[int, Pattern]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            if not left:
                break
            each = room // length
            waiting = open_bins.pop(room)
            while waiting and left >= each:
                times, pattern = waiting.pop()
                used = min(times, left // each)
                left -= used * each
                filled = (*pattern, (length, each))
                open_bins.setdefault(room - each * length, []).append((used, filled))
                if used < times:
                    waiting.append((times - used, pattern))
                    break
            if 0 < left < each and waiting:
                times, pattern = waiting.pop()
                open_bins.setdefault(room - left * length, []).append((1, (*pattern, (length, left))))
                left = 0
                if times > 1:
                    waiting.append((times - 1, pattern))
            if waiting:
                open_bins.setdefault(room, []).extend(waiting)
        each = capacity // length
        whole, rest = divmod(left, each)
        if whole:
            open_bins.setdefault(capacity - each * length, []).append((whole, ((length, each),)))
        if rest:
            open_bins.setdefault(capacity - rest * length, []).append((1, ((length, rest),)))
    return [item for room in sorted(open_bins) for item in open_bins[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The greater of total over capacity and the bound by lengths that can't share a bin."""
    total = sum(length * n for length, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for cut in lengths:
        if 2 * cut > capacity:
            break
        alone = sum(n for length, n in counts.items() if length > capacity - cut)
        large = [(length, n) for length, n in counts.items() if capacity / 2 < length <= capacity - cut]
        room = sum(n * (capacity - length) for length, n in large)
        small = sum(length * n for length, n in counts.items() if cut <= length <= capacity / 2)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def fillings(
    lengths: list[int], counts: dict[int, int], room: int, most: int = FILLINGS, steps: int = STEPS
) -> list[Pattern]:
    """The ``most`` least wasteful of the undominated fillings of ``room`` met in ``steps`` steps.

    ``lengths`` are in falling order. A filling is dominated when an unused length
    fits beside it, or could take the place of a shorter one of it.
    """
    found: list[tuple[int, Pattern]] = []
    budget = steps

    rising = lengths[::-1]

    def dominated(filling: list[tuple[int, int]], slack: int) -> bool:
        used = dict(filling)

        def spare(low: int, high: int) -> bool:
            for at in range(bisect_right(rising, low), len(rising)):
                if rising[at] > high:
                    return False
                if counts[rising[at]] > used.get(rising[at], 0):
                    return True
            return False

        return spare(0, slack) or any(spare(short, short + slack) for short in used)

    def extend(at: int, left: int, filling: list[tuple[int, int]]) -> bool:
        nonlocal budget
        budget -= 1
        while at < len(lengths) and (lengths[at] > left or not counts[lengths[at]]):
            at += 1
        if left == 0 or at == len(lengths):
            if not (left and dominated(filling, left)):
                found.append((left, tuple(filling)))
            return left == 0 or len(found) >= 4 * most
        length = lengths[at]
        for number in range(min(counts[length], left // length), -1, -1):
            taken = [*filling, (length, number)] if number else filling
            if extend(at + 1, left - number * length, taken) or budget <= 0:
                return True
        return False

    extend(0, room, [])
    found.sort(key=lambda item: (item[0], len(item[1])))
    if not found:  # out of steps: fill greedily
        filling, left = [], room
        for length in lengths:
            number = min(counts[length], left // length)
            if number:
                filling.append((length, number))
                left -= number * length
        found.append((left, tuple(filling)))
    return [filling for _, filling in found[:most]]


def complete_bins(
    counts: dict[int, int],
    capacity: int = CAPACITY,
    nodes: int = NODES,
    most: int = FILLINGS,
    steps: int = STEPS,
) -> list[tuple[int, Pattern]]:
    """(times, pattern) of a packing in as few bins as the search finds.

    The search visits ``nodes`` nodes at most and tries ``most`` fillings at each, looked
    for in ``steps`` steps; beyond these bounds the best packing so far stands.

    Every node uses up a length, so a packing has at most as many patterns as
    lengths. A node tries a filling in one block, as often as the counts allow.
    """
    counts = {length: n for length, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    fewest = sum(times for times, _ in incumbent)
    goal = lower_bound(counts, capacity)
    total = sum(length * n for length, n in counts.items())
    if fewest <= goal:
        return incumbent
    left = dict(counts)
    path: list[tuple[int, Pattern]] = []
    waste = bins = 0

    def choices() -> list[Pattern]:
        lengths = sorted((length for length, n in left.items() if n), reverse=True)
        largest = lengths[0]
        left[largest] -= 1
        tried = fillings(lengths, left, capacity - largest, most, steps)
        left[largest] += 1
        patterns = []
        for filling in tried:
            own = dict(filling)
            own[largest] = own.get(largest, 0) + 1
            patterns.append(tuple(sorted(own.items(), reverse=True)))
        return patterns

    stack = [choices()]
    for _ in range(nodes):
        while stack and not stack[-1]:
            stack.pop()
            if path:
                times, pattern = path.pop()
                bins -= times
                waste -= times * (capacity - sum(a * b for a, b in pattern))
                for length, number in pattern:
                    left[length] += times * number
        if not stack:
            break
        pattern = stack[-1].pop(0)
        times = min(left[length] // number for length, number in pattern)
        lost = times * (capacity - sum(a * b for a, b in pattern))
        if waste + lost > (fewest - 1) * capacity - total:
            continue
        for length, number in pattern:
            left[length] -= times * number
        path.append((times, pattern))
        bins, waste = bins + times, waste + lost
        if any(left.values()):
            stack.append(choices())
            continue
        if bins < fewest:
            incumbent, fewest = list(path), bins
            if fewest <= goal:
                break
        stack.append([])
    return incumbent


def _placement(plan: list[tuple[int, Pattern]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: rank a stretch begins at, its first sequence, pieces a sequence, offset."""
    stretches: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        offset = 0
        for length, number in pattern:
            rank = taken.get(length, 0)
            stretches.setdefault(length, []).append((rank, sequence, number, offset))
            taken[length] = rank + times * number
            offset += length * number
        sequence += times
    return {
        length: tuple(np.array(column, np.int64) for column in zip(*rows))
        for length, rows in stretches.items()
    }


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with (sequence_id, offset). ``pieces`` is read three times; give a written table.

    A length's pieces are ranked in salted groups of about ``RANKED_ROWS``, whose
    first ranks come from their counts, so a length that a third of all pieces
    share is ranked in many tasks.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = _placement(complete_bins(counts, capacity))
    salts = -(-max(counts.values(), default=1) // RANKED_ROWS)
    salted = pieces.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        salted.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1)
    kind = T.StructType(
        [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            starts, first, each, begins = places[int(length)]
            at = np.searchsorted(starts, rank[rows], side="right") - 1
            beyond = rank[rows] - starts[at]
            sequence[rows] = first[at] + beyond // each[at]
            offset[rows] = begins[at] + beyond % each[at] * length
        return pa.StructArray.from_arrays(
            [pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"]
        )

    rank = (F.col("first") + F.col("rank")).cast("long")
    return (
        ranked.join(firsts, ["length", "salt"])
        .withColumn("place", F.arrow_udf(place, kind)("length", rank))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "place.*")
    )


def pack_documents(
    docs: DataFrame, path: str | None = None, workspace: Workspace | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    ``path`` is the tokenizer file on the executors. The pieces are staged once.
    """
    workspace = workspace or scratch(docs.sparkSession, "packing")
    return pack_pieces(workspace.stage(token_pieces(docs, path), "pieces"))
