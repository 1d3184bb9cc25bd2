"""Best-fit packing of token sequences by linear grouping and few-size configurations."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm.common import saved

CAPACITY = 2048
END_ID = 0

# Lengths above a quarter of a sequence are large, so that at most three fit into one;
# they are rounded in so many groups of equal cardinality.
LARGE_SHARE = 4
GROUPS = 256

# A worker keeps words in two generations of about so many, and so many parts of words,
# none longer than this, and takes texts of about so many bytes at a time.
_CACHE_WORDS, _CACHE_PARTS = 250_000, 500_000
_CACHE_BYTES = 64
_ENCODED = 4096
_SLICE_BYTES = 4_000_000
_BLOCK_ROWS = 200_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- tokens ---------------------------------------------------------------------------

def _plain_split(path: str):
    """How the tokenizer cuts a printable ASCII word into the parts that its model sees,
    if that can be said by one pattern on the word in small letters; else None."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = (made["normalizer"] or {}).get("normalizers", [])
    cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
    known = known and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and "Regex" in cuts[0]["pattern"]
    known = known and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    if not known or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"]).findall


class WordIds:
    """Ids of words as little-endian bytes. The tokenizer never joins text across white
    space, so a document's ids are those of its words one after the other. Each distinct
    word of many texts is looked up once. Of words not yet known, printable ASCII ones are
    put together from their parts, which many words share; all others are encoded whole,
    many at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.split = _plain_split(path)
        added = sorted(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = np.array([t.id for t in self.model.tokenize(part)], "<u4").tobytes()
            if len(part) <= _CACHE_BYTES:
                self.parts[part] = found
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        learned: dict[str, bytes] = {}
        whole = words
        if self.split is not None:
            if len(self.parts) > _CACHE_PARTS:
                self.parts = {}
            whole = []
            for word in words:
                if word.isascii() and word.isprintable() and not self.added(word):
                    learned[word] = b"".join(map(self._part, self.split(word.lower())))
                else:
                    whole.append(word)
        for at in range(0, len(whole), _ENCODED):
            part = whole[at : at + _ENCODED]
            found = self.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = 4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part)), "right")
            learned.update((word, ids[begin:end]) for word, (begin, end) in zip(part, pairwise([0, *ends.tolist()])))
        return learned

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > _CACHE_WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k in missing:
            found[k] = self.older.get(words[k])
        learned = self._learn([words[k] for k in missing if found[k] is None])
        for k in missing:
            if found[k] is None:
                found[k] = learned[words[k]]
        self.known.update((words[k], found[k]) for k in missing if len(words[k]) <= _CACHE_BYTES)
        return found

    def of(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._ids(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        word_ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])
        text_ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
        data = memoryview(ids.buffers()[2] or b"")
        for begin, end in pairwise(word_ends[text_ends].tolist()):
            yield data[begin:end].tobytes()


def _worker_words(path: str) -> WordIds:
    """The words of this worker process, which tasks that run in it one after the other
    share. A task brings its functions anew, so the words are kept with the library."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_tidelog_words", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with texts of about ``_SLICE_BYTES`` together, one at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // _SLICE_BYTES
    for begin, end in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]):
        yield batch.slice(begin, end - begin)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on request, the
    ``ids`` as little-endian unsigned 32-bit numbers. Only documents longer than a
    sequence are cut; NULL and empty texts are the end id alone."""
    width, end = 4 * capacity, np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(tokenizer)
        for batch in chain.from_iterable(map(_slices, batches)):
            rows: list[tuple] = []
            for doc, known in zip(batch.column("doc_id").to_pylist(), words.of(batch.column("text"))):
                ids = known + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


# --- plan -------------------------------------------------------------------------------

def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths, longest first, in groups of equal cardinality (a length may be shared by
    two): the longest of each and its ``(length, count)`` parts."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    found: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                found.append((length, []))
                room = size
            take = min(left, room)
            found[-1][1].append((length, take))
            room -= take
            left -= take
    return found


def _configuration(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[int]:
    """Groups that fill one sequence: the longest size left, and the one or two further
    ones that leave the least room. ``sizes`` fall; none is so short that four would fit."""
    first = int(np.flatnonzero(left)[0])
    left = left.copy()
    left[first] -= 1
    there = np.flatnonzero(left)[::-1]  # shortest first
    have = sizes[there]
    room = capacity - int(sizes[first])
    fit = int(np.searchsorted(have, room, "right"))
    if not fit:
        return [first]
    best, chosen = int(have[fit - 1]), [first, int(there[fit - 1])]
    # with each second size the longest third one, the same only if there are two
    second = np.arange(fit)
    third = np.minimum(np.searchsorted(have, room - have[:fit], "right") - 1, second)
    third = np.where((third == second) & (left[there[:fit]] < 2), third - 1, third)
    both = np.where(third >= 0, have[:fit] + have[np.maximum(third, 0)], 0)
    if both.max() > best:
        k = int(both.argmax())
        chosen = [first, int(there[k]), int(there[third[k]])]
    return chosen


class Plan:
    """Runs of equal sequences. A slot says: pieces of ``length`` numbered from ``rank``
    on, ``count`` of them, go to sequences numbered from ``sequence`` on, at ``offset``."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.ranks: dict[int, int] = {}
        self.slots: list[tuple[int, int, int, int, int]] = []
        # gaps[g]: runs (first sequence, number of them) with g tokens free
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.free: list[int] = []

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.ranks[length] = rank + count
        self.slots.append((length, rank, count, sequence, offset))

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def leave(self, gap: int, sequence: int, count: int) -> None:
        if gap > 0 and count:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.free, gap)
            self.gaps[gap].append((sequence, count))

    def fill_best(self, length: int, count: int) -> None:
        """Best fit: each piece goes where the least room is left."""
        while count:
            at = bisect_left(self.free, length)
            if at == len(self.free):
                per = self.capacity // length
                full, rest = divmod(count, per)
                for many, number in ((per, full), (rest, int(rest > 0))):
                    if number:
                        first = self.open(number)
                        for k in range(many):
                            self.place(length, number, first, k * length)
                        self.leave(self.capacity - many * length, first, number)
                return
            gap = self.free[at]
            sequence, runs = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
                self.free.pop(at)
            per = gap // length
            take = min(runs, -(-count // per))
            self.leave(gap, sequence + take, runs - take)
            full = min(take, count // per)
            for many, number, first in ((per, full, sequence), (count - full * per, take - full, sequence + full)):
                if number:
                    for k in range(many):
                        self.place(length, number, first, self.capacity - gap + k * length)
                    self.leave(gap - many * length, first, number)
            count -= min(count, full * per + (take - full) * (count - full * per))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Sequences for pieces of the given lengths and numbers; only these numbers decide,
    so the work does not grow with the pieces.

    Large lengths are rounded up to the longest of their group of equal cardinality.
    Configurations of at most three rounded sizes are chosen, longest size first, each as
    often as its groups last; then the groups' own pieces take the places, longest first,
    which leaves the room that rounding had claimed. Small pieces, longest first, go to
    the sequence with the least room that holds them.
    """
    made = Plan(capacity)
    large = {x: n for x, n in counts.items() if x * LARGE_SHARE > capacity}
    if capacity in large:
        n = large.pop(capacity)
        made.place(capacity, n, made.open(n), 0)
    grouped = linear_groups(large, groups)
    sizes = np.array([size for size, _ in grouped], np.int64)
    members = [list(parts) for _, parts in grouped]
    left = np.array([sum(n for _, n in parts) for parts in members], np.int64)
    while left.any():
        chosen = _configuration(sizes, left, capacity)
        times = min(int(left[k]) // chosen.count(k) for k in chosen)
        # substitute the groups' own pieces: runs in which every slot has one length
        cuts = {0, times}
        queues = []
        for k in chosen:
            queue, need = [], times
            while need:
                length, n = members[k][0]
                take = min(n, need)
                queue.append((length, take))
                members[k][0] = (length, n - take)
                if n == take:
                    members[k].pop(0)
                need -= take
            left[k] -= times
            queues.append(queue)
            at = 0
            for _, n in queue:
                at += n
                cuts.add(at)
        for begin, stop in pairwise(sorted(cuts)):
            first, offset = made.open(stop - begin), 0
            for queue in queues:
                at = 0
                for length, n in queue:
                    if at <= begin < at + n:
                        made.place(length, stop - begin, first, offset)
                        offset += length
                    at += n
            made.leave(capacity - offset, first, stop - begin)
    for length in sorted((x for x in counts if x * LARGE_SHARE <= capacity), reverse=True):
        made.fill_best(length, counts[length])
    return made


# --- pieces to places --------------------------------------------------------------------

def _placer(made: Plan):
    """Places of pieces by length and rank: the slot whose ranks hold the piece's own."""
    by_length: dict[int, tuple] = {}
    slots = np.array(made.slots, np.int64).reshape(-1, 5)
    for length in np.unique(slots[:, 0]):
        own = slots[slots[:, 0] == length]
        by_length[int(length)] = own[np.argsort(own[:, 1], kind="stable")][:, [1, 3, 4]]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine, own = np.flatnonzero(length == value), by_length[int(value)]
                slot = own[np.searchsorted(own[:, 0], rank[mine], "right") - 1]
                sequence[mine] = slot[:, 1] + rank[mine] - slot[:, 0]
                offset[mine] = slot[:, 2]
            names = [n for n in batch.schema.names if n != "rank"]
            arrays = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return locate


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Adds ``rank``, a piece's number among those of its length. Pieces of a length are
    dealt to blocks and numbered there; blocks grow in number with the rows, so that one
    length may hold any share of them."""
    blocks = max(16, rows // _BLOCK_ROWS)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    sizes = dealt.groupBy(F.col("length").alias("b_length"), F.col("block").alias("b_block")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("b_length").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("b_length", "b_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_number", F.row_number().over(within) - 1)
    same = (F.col("length") == F.col("b_length")) & (F.col("block") == F.col("b_block"))
    return numbered.join(offsets, same).select(*pieces.columns, (F.col("before") + F.col("_number")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places: ``sequence_id`` and ``offset``, gapless
    from 0 in sequences of at most ``capacity`` tokens.

    A NULL text is empty and has the end id alone; a NULL doc_id is kept; rows that
    repeat a document are packed once each. An empty table gives an empty result; extra
    columns are left out. The numbers of pieces per length, at most ``capacity`` of them,
    go to the driver, which plans sequences by runs.
    """
    pieces = saved(pieces_of(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    columns = pieces.columns
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    numbered = ranked(pieces, sum(counts.values())).select(*columns, "rank")
    return numbered.mapInArrow(_placer(plan(counts, capacity)), schema)
