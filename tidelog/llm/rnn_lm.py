"""Scoring texts with a gated recurrent language model trained on the corpus."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import saved

# Words with an output of their own, in classes of equal frequency; all other words are
# in a class that follows from their last two characters.
FREQUENT = 512
FREQUENT_CLASSES = 24
FORM_CLASSES = 40
HIDDEN = 12

# Texts side by side, and steps of a window: gradients end where a window begins, states
# go on through all windows of a document. Where few texts are left, windows are longer.
LANES = 512
STEPS = 16
LONGER = 8
CELLS = 4096
RATE = 6e-3
WARM_DOCS = 2_000

ADD = 0.1
FOLDS = 10

# Tokens that are scored together with the counts of their words.
BATCH_TOKENS = 2_000_000
# Tokens of whole texts that go through the network together when they are scored.
PART_TOKENS = 1_000_000
# Cells whose numbers for all classes are made at a time, few enough to stay near the core.
BLOCK = 2048
# Logits whose exponentials are not cut.
SAFE = 60.0
_LOG10 = np.log(10.0)
_END = xxhash.xxh3_64_intdigest(b"end of text", seed=1)


# --- words ------------------------------------------------------------------------------

END_WORD = _END >> 8 << 8


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, A-Z in lower case, and words per text."""
    bare = pc.ascii_lower(pc.ascii_trim_whitespace(texts))
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), pa.scalar(None, bare.type), bare))
    return found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hash of each word and its form class, the class in the lowest bits."""
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    forms = np.array([zlib.crc32(end.encode()) % FORM_CLASSES for end in ends.dictionary.to_pylist()], np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))
    return own >> np.uint64(8) << np.uint64(8) | forms[ends.indices.to_numpy()]


def places_of(parts: list[pa.Array], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of texts, ascending, and the place in them of every
    token: the words of each text, then one end. A word is hashed once."""
    found = pa.chunked_array(parts).dictionary_encode().combine_chunks()
    hashes, at = np.unique(np.append(word_hashes(found.dictionary), np.uint64(END_WORD)), return_inverse=True)
    at = at.astype(np.uint32)
    is_word = np.ones(int(sizes.sum()) + len(sizes), bool)
    is_word[np.cumsum(sizes + 1) - 1] = False
    places = np.full(len(is_word), at[-1], np.uint32)
    places[is_word] = at[found.indices.to_numpy()]
    return hashes, places


@dataclass
class Vocabulary:
    """Frequent words with their classes, most frequent first, and what the form classes
    weigh. Ids: a frequent word's place, then the form classes, then the start."""

    hashes: np.ndarray  # of the frequent words
    classes: np.ndarray  # of the frequent words, ascending
    masses: np.ndarray  # of the form classes: sums of count + ADD, once more ADD for words never seen

    @staticmethod
    def of(frequent: list[tuple[int, int]], masses: dict[int, float]) -> "Vocabulary":
        counts = np.array([n for _, n in frequent], float)
        before = (np.cumsum(counts) - counts / 2) / max(counts.sum(), 1)
        _, classes = np.unique((before * FREQUENT_CLASSES).astype(np.int64), return_inverse=True)
        form = np.array([masses.get(k, 0.0) + ADD for k in range(FORM_CLASSES)])
        return Vocabulary(np.array([h for h, _ in frequent], np.int64).view(np.uint64), classes, form)

    @property
    def n_frequent_classes(self) -> int:
        return int(self.classes[-1]) + 1 if len(self.classes) else 0

    @property
    def start(self) -> int:
        return len(self.hashes) + FORM_CLASSES

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        form = (hashes & np.uint64(255)).astype(np.int64) + len(self.hashes)
        if not len(self.hashes):
            return form
        order = np.argsort(self.hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes, sorter=order), len(order) - 1)
        return np.where(self.hashes[order[at]] == hashes, order[at], form)

    def class_of(self) -> np.ndarray:
        """Class of every id but the start."""
        return np.concatenate([self.classes, np.arange(FORM_CLASSES) + self.n_frequent_classes]).astype(np.int64)

    def bounds(self) -> list[tuple[int, int]]:
        """First and last (exclusive) frequent word of each class."""
        edges = np.searchsorted(self.classes, np.arange(self.n_frequent_classes + 1))
        return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


# --- the network ---------------------------------------------------------------------------

def shapes(vocabulary: Vocabulary) -> dict[str, tuple[int, ...]]:
    k, c = len(vocabulary.hashes), vocabulary.n_frequent_classes + FORM_CLASSES
    return {
        "input": (vocabulary.start + 1, 3 * HIDDEN), "gates": (HIDDEN, 3 * HIDDEN),
        # the last row is what each output has without any state
        "class": (HIDDEN + 1, c), "word": (HIDDEN + 1, k),
    }


def unpack(flat: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for name, shape in shapes(vocabulary).items():
        size = int(np.prod(shape))
        found[name] = flat[at : at + size].reshape(shape)
        at += size
    return found


def first_weights(vocabulary: Vocabulary, seed: int = 9) -> np.ndarray:
    random = np.random.RandomState(seed)
    flat = np.concatenate([(random.randn(*shape) * 0.15).astype(np.float32).reshape(-1) for shape in shapes(vocabulary).values()])
    p = unpack(flat, vocabulary)
    p["class"][HIDDEN] = p["word"][HIDDEN] = 0
    return flat


def lanes(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts dealt to lanes, longest first to the emptiest one: for every lane, longest
    lane first, its length; for every text, its lane and where it starts there."""
    width = max(1, min(width, len(sizes)))
    heap = [(0, k) for k in range(width)]
    lane, start, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(width, np.int64)
    for text in np.argsort(-sizes, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        lane[text], start[text] = k, used
        total[k] = used + sizes[text]
        heapq.heappush(heap, (int(total[k]), k))
    order = np.argsort(-total, kind="stable")
    place = np.empty(width, np.int64)
    place[order] = np.arange(width)
    return total[order], place[lane], start


class Grid:
    """Token ids of texts laid out in lanes, step by step. Longer lanes come first, so
    the lanes that reach a step are the first ones, and no cell is empty."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, start: int, width: int = LANES):
        self.lengths, lane, begin = lanes(sizes, width)
        steps = int(self.lengths.max(initial=0))
        # lanes at each step, and cells before it
        self.active = np.cumsum(np.bincount(self.lengths, minlength=steps + 1)[::-1])[::-1][1:]
        self.before = np.concatenate([[0], np.cumsum(self.active)])
        first = np.cumsum(sizes) - sizes
        step = np.arange(len(ids), dtype=np.int32)
        step -= np.repeat((first - begin).astype(np.int32), sizes)
        #: the cell of every token, to put scores back
        self.cell = self.before.astype(np.int32)[step]
        del step
        self.cell += np.repeat(lane.astype(np.int32), sizes)
        previous = np.empty(len(ids), np.uint16)
        previous[1:] = ids[:-1]
        previous[first] = start
        self.target, self.input = np.empty(len(ids), np.uint16), np.empty(len(ids), np.uint16)
        #: whether a cell goes on with the text of the one before
        self.inner = np.ones(len(ids), bool)
        self.target[self.cell], self.input[self.cell] = ids, previous
        self.inner[self.cell[first]] = False

    def goes_on(self, cells: slice, steps: int, active: int) -> np.ndarray:
        return self.inner[cells].astype(np.float32).reshape(steps, 1, active)

    def windows(self, steps: int, cells: int = 0) -> Iterator[tuple[slice, int, int]]:
        """The cells of each window, its steps and its lanes. A window ends early where a
        lane ends; with few lanes it goes on to ``cells`` cells, but not beyond ``LONGER``
        times the steps, as each window costs much beside its cells."""
        at, end = 0, len(self.active)
        while at < end:
            active = int(self.active[at])
            wanted = max(steps, min(LONGER * steps, cells // active))
            stop = min(at + wanted, int(self.lengths[active - 1]))
            yield slice(int(self.before[at]), int(self.before[stop])), stop - at, active
            at = stop


def _forward(p: dict[str, np.ndarray], grid: Grid, cells: slice, steps: int, active: int, state: np.ndarray, keep: bool):
    """States after every step of a window, each with a one behind it, and what going back
    needs. A step's numbers lie unit by unit, lanes side by side, so that gates are whole
    stretches of memory."""
    h, half = HIDDEN, np.float32(0.5)
    # a sigmoid is made from tanh at half its argument
    halves = np.repeat(np.array([half, 1], np.float32), [2 * h, h])
    x = np.ascontiguousarray((p["input"] * halves)[grid.input[cells]].reshape(steps, active, 3 * h).transpose(0, 2, 1))
    goes_on = grid.goes_on(cells, steps, active)
    gates = np.ascontiguousarray((p["gates"] * halves).T)
    states = np.empty((steps, h + 1, active), np.float32)
    states[:, h] = 1
    trace = []
    for t in range(steps):
        state = state * goes_on[t]
        g = gates @ state
        rz, gc, a = g[: 2 * h], g[2 * h :], x[t]
        rz += a[: 2 * h]
        np.tanh(rz, rz)
        rz *= half
        rz += half
        c = rz[:h] * gc
        c += a[2 * h :]
        np.tanh(c, c)
        away = state - c
        if keep:
            trace.append((state, g, c, away))
        state = np.multiply(away, rz[h:], states[t, :h])
        state += c
    return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, h + 1), state, trace


def _blocks(n: int) -> Iterator[slice]:
    return (slice(at, min(at + BLOCK, n)) for at in range(0, n, BLOCK))


def _safe(outputs: np.ndarray) -> bool:
    """Whether no state can lead to a logit that must be cut: states lie between -1 and 1."""
    return float(np.abs(outputs).sum(axis=0).max(initial=0)) < SAFE


def _exponentials(logits: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in the place of the logits, and their sum; logits stay small enough
    to need no shift once they are cut."""
    if not safe:
        np.minimum(logits, np.float32(SAFE), logits)
    np.exp(logits, logits)
    return logits, logits @ np.ones(logits.shape[1], np.float32)


def _chosen(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logits one after the other, and where in them the targets are."""
    return logits.reshape(-1), np.arange(0, logits.size, logits.shape[1]) + targets


def _log_share(flat: np.ndarray, outputs: np.ndarray, targets: np.ndarray, safe: bool) -> np.ndarray:
    """Log of the share that each target has of the outputs."""
    logits = flat @ outputs
    every, at = _chosen(logits, targets)
    score = every[at]
    return score - np.log(_exponentials(logits, safe)[1])


def _errors(flat: np.ndarray, outputs: np.ndarray, targets: np.ndarray, parts: list[tuple[slice, slice]], share: np.float32, slope: np.ndarray) -> np.ndarray:
    """Adds the slopes of the mean loss at the outputs, returns those at the states. Parts
    are tokens and the outputs that they choose from."""
    safe, errors, total = _safe(outputs), [], np.empty(len(flat), np.float32)
    for own, columns in parts:
        error, total[own] = _exponentials(flat[own] @ outputs[:, columns], safe)
        every, at = _chosen(error, targets[own])
        every[at] -= total[own]
        errors.append(error)
    # the errors are these times a number per token, which costs less on the few units
    scale = (share / total)[:, None]
    scaled, back = flat * scale, np.empty((len(flat), HIDDEN), np.float32)
    for error, (own, columns) in zip(errors, parts):
        slope[:, columns] += scaled[own].T @ error
        np.matmul(error, outputs[:HIDDEN, columns].T, back[own])
    back *= scale
    return back


def _by_class(classes: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
    """Tokens of the classes with several words, class by class, and for each class that
    occurs its tokens and its words."""
    order = _order(classes)
    edges = np.searchsorted(classes[order], np.arange(len(bounds) + 1)).tolist()
    parts, taken, n = [], [np.zeros(0, np.int64)], 0
    for first, last, (low, high) in zip(edges, edges[1:], bounds):
        if last > first and high - low > 1:
            parts.append((slice(n, n + last - first), slice(low, high)))
            taken.append(order[first:last])
            n += last - first
    return np.concatenate(taken), parts


def _order(ids: np.ndarray) -> np.ndarray:
    """The order of small numbers, equal ones as they come; 16 bits are sorted by counting."""
    return np.argsort(ids.astype(np.uint16), kind="stable")


def token_scores(weights: np.ndarray, vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Natural log probability of every token: of its class by the state, and within the
    class by the state for frequent words, by ``inside`` for the others."""
    p, class_of, bounds = unpack(weights, vocabulary), vocabulary.class_of(), vocabulary.bounds()
    grid = Grid(ids, sizes, vocabulary.start)
    result = np.zeros(len(ids), np.float32)
    state = np.zeros((HIDDEN, len(grid.lengths)), np.float32)
    safe_class, safe_word = _safe(p["class"]), _safe(p["word"])
    for cells, steps, active in grid.windows(4 * STEPS, 4 * CELLS):
        flat, state, _ = _forward(p, grid, cells, steps, active, state[:, :active], False)
        target = grid.target[cells]
        classes = class_of[target]
        score = np.concatenate([_log_share(flat[own], p["class"], classes[own], safe_class) for own in _blocks(len(flat))])
        mine, parts = _by_class(classes, bounds)
        inner, target = flat[mine], target[mine]
        for own, words in parts:
            score[mine[own]] += _log_share(inner[own], p["word"][:, words], target[own] - words.start, safe_word)
        result[cells] = score
    return result[grid.cell] + inside


def _slopes(p: dict[str, np.ndarray], grid: Grid, window: tuple[slice, int, int], state: np.ndarray, class_of: np.ndarray, bounds, slope: dict[str, np.ndarray]):
    """Gradients of the mean loss of one window, and the state it ends with."""
    cells, steps, active = window
    flat, last, trace = _forward(p, grid, cells, steps, active, state.T, True)
    target = grid.target[cells]
    classes = class_of[target]
    share = np.float32(1 / len(target))
    slope["class"][:], slope["word"][:] = 0, 0
    back = np.concatenate([_errors(flat[own], p["class"], classes[own], [(slice(None), slice(None))], share, slope["class"]) for own in _blocks(len(flat))])
    mine, parts = _by_class(classes, bounds)
    if parts:
        back[mine] += _errors(flat[mine], p["word"], target[mine] - np.array([low for low, _ in bounds])[classes[mine]], parts, share, slope["word"])
    h, after = HIDDEN, np.zeros((HIDDEN, active), np.float32)
    back = np.ascontiguousarray(back.reshape(steps, active, h).transpose(0, 2, 1))
    goes_on = grid.goes_on(cells, steps, active)
    # slopes at the gates' sums: for the candidate what comes from the input, both gates,
    # and for the candidate what comes from the state
    sums = np.empty((4 * h, steps, active), np.float32)
    for t in range(steps - 1, -1, -1):
        before, g, c, away = trace[t]
        r, z, gc = g[:h], g[h : 2 * h], g[2 * h :]
        d, own = back[t], sums[:, t]
        d += after
        keep = np.float32(1) - z
        dc = own[:h]
        np.multiply(c, c, dc)
        np.subtract(np.float32(1), dc, dc)
        dc *= keep
        dc *= d
        last_rows = np.multiply(dc, r, own[3 * h :])
        # r - r * r times dc is what dc times r lacks of r
        dr = own[h : 2 * h]
        np.subtract(np.float32(1), r, dr)
        dr *= last_rows
        dr *= gc
        keep *= z
        keep *= away
        np.multiply(keep, d, own[2 * h : 3 * h])
        after = p["gates"] @ own[h:]
        d *= z
        after += d
        after *= goes_on[t]
    slope["gates"][:] = np.concatenate([x[0] for x in trace], axis=1) @ sums[h:].reshape(3 * h, -1).T
    ids = grid.input[cells]
    order = _order(ids)
    begin = np.flatnonzero(np.diff(ids[order], prepend=-1))
    summed = np.add.reduceat(sums[: 3 * h].reshape(3 * h, -1).take(order, axis=1, mode="clip"), begin, axis=1).T
    slope["input"][:] = 0
    slope["input"][ids[order[begin]]] = np.roll(summed, -h, axis=1)
    return last.T


def train(weights: np.ndarray, vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, rate: float = RATE, moments: list | None = None) -> np.ndarray:
    """One pass over the texts with truncated backpropagation, a step per window."""
    weights = weights.copy()
    p, class_of, bounds = unpack(weights, vocabulary), vocabulary.class_of(), vocabulary.bounds()
    grid = Grid(ids, sizes, vocabulary.start)
    flat_slope = np.zeros_like(weights)
    slope = unpack(flat_slope, vocabulary)
    if moments is None:
        moments = [np.zeros_like(weights), np.zeros_like(weights), 0]
    mean, square, state = moments[0], moments[1], np.zeros((len(grid.lengths), HIDDEN), np.float32)
    for window in grid.windows(STEPS, CELLS):
        steps, active = window[1:]
        state = _slopes(p, grid, window, state[:active], class_of, bounds, slope)
        norm = float(np.sqrt(np.dot(flat_slope, flat_slope)))
        if norm > 1:
            flat_slope /= np.float32(norm)
        moments[2] += 1
        mean += np.float32(0.1) * (flat_slope - mean)
        square += np.float32(0.01) * (flat_slope * flat_slope - square)
        n = moments[2]
        # few lanes at the end of a grid count for less, by as much as they go on for longer
        step = rate * min(1.0, active / len(grid.lengths) * max(steps / STEPS, 1)) * (1 - 0.99**n) ** 0.5 / (1 - 0.9**n)
        weights -= np.float32(step) * mean / (np.sqrt(square) + np.float32(1e-7))
    return weights


# --- on Spark ---------------------------------------------------------------------------------

ENCODED_SCHEMA = (
    "batch long, doc_ids binary, there binary, held binary, sizes binary, tokens binary, words binary, taught binary"
)


def _held_out(doc) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % FOLDS == 0


def encoded(docs: DataFrame, tokens_per_batch: int = BATCH_TOKENS) -> DataFrame:
    """Documents in batches of about ``tokens_per_batch`` tokens, a row each: every token
    as the place of its word among the batch's words, the words' hashes in ascending
    order, and how often each occurs in the documents to learn from."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, parts, sizes = [], [], []

        def row() -> pa.RecordBatch:
            nonlocal number, ids, parts, sizes
            size = np.concatenate(sizes)
            words, places = places_of(parts, size)
            size += 1
            held = np.array([_held_out(d) for d in ids], bool)
            taught = np.bincount(places[np.repeat(~held, size)], minlength=len(words))
            columns = {
                "doc_ids": np.array([d or 0 for d in ids], np.int64), "there": np.array([d is not None for d in ids]),
                "held": held, "sizes": size, "tokens": places, "words": words, "taught": taught.astype(np.int64),
            }
            found = {"batch": pa.array([number], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}
            number, ids, parts, sizes = number + 1, [], [], []
            return pa.RecordBatch.from_pydict(found)

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words, size = split_words(batch.column("text"))
                ids += batch.column("doc_id").to_pylist()
                parts.append(words)
                sizes.append(size)
                if len(ids) + sum(map(len, parts)) >= tokens_per_batch:
                    yield row()
        if ids:
            yield row()
        # the worker lives on, and what Arrow has freed would stay with it
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED_SCHEMA)


def _array(column: pa.Array, row: int, dtype) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), dtype)


def word_rows(batches_: DataFrame) -> DataFrame:
    """``batch, place, h, n``: the words of each batch."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = _array(batch.column("words"), k, np.int64)
                number = np.full(len(words), batch.column("batch")[k].as_py(), np.int64)
                n = _array(batch.column("taught"), k, np.int64)
                yield pa.RecordBatch.from_pydict({"batch": number, "place": np.arange(len(words), dtype=np.int32), "h": words, "n": n})

    return batches_.select("batch", "words", "taught").mapInArrow(explode, "batch long, place int, h long, n long")


def _text_parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """The texts in runs of about ``most`` tokens."""
    ends = np.cumsum(sizes)
    run = (ends - 1) // most
    edges = np.flatnonzero(np.diff(run, prepend=-1)).tolist() + [len(sizes)]
    return (slice(low, high) for low, high in zip(edges, edges[1:]))


def _lessons(batch: pa.RecordBatch, k: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of the documents of a batch to learn from."""
    held, sizes = _array(batch.column("held"), k, bool), _array(batch.column("sizes"), k, np.int64)
    ids = vocabulary.ids(_array(batch.column("words"), k, np.uint64)).astype(np.uint16)[_array(batch.column("tokens"), k, np.uint32)]
    return ids[np.repeat(~held, sizes)], sizes[~held]


def _warm_start(batches_: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights to start from: one pass over at most ``WARM_DOCS`` documents."""
    first = first_weights(vocabulary)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = _lessons(batch, k, vocabulary)
                sizes = sizes[:WARM_DOCS]
                yield pa.RecordBatch.from_pydict({"weights": [train(first, vocabulary, ids[: sizes.sum()], sizes).tobytes()]})

    # the batch is found by its number alone; sorting whole batches would move one per task
    number = batches_.agg(F.min("batch")).first()[0]
    one = batches_.where(F.col("batch") == number).mapInArrow(learn, "weights binary").collect() if number is not None else []
    return np.frombuffer(one[0]["weights"], np.float32) if one else first


def fit(batches_: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after one pass over all documents to learn from. Tasks go on from the same
    start, each over its own documents; their weights are averaged by tokens."""
    start = _warm_start(batches_, vocabulary)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moments, tokens = start, [np.zeros_like(start), np.zeros_like(start), 0], 0
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = _lessons(batch, k, vocabulary)
                if len(ids):
                    weights, tokens = train(weights, vocabulary, ids, sizes, RATE, moments), tokens + len(ids)
        if tokens:
            yield pa.RecordBatch.from_pydict(
                {"place": np.arange(len(weights), dtype=np.int32), "value": weights.astype(float) * tokens, "tokens": np.full(len(weights), float(tokens))}
            )

    learned = batches_.select("held", "sizes", "tokens", "words").mapInArrow(learn, "place int, value double, tokens double")
    mean = learned.groupBy("place").agg((F.sum("value") / F.sum("tokens")).alias("value")).collect()
    weights = start.copy()
    weights[[r["place"] for r in mean]] = [r["value"] for r in mean]
    return weights


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: the log10
    probability of each whole text under the word counts of the documents to learn from,
    and under the recurrent model trained on them.

    One document in ``FOLDS``, by the checksum of its id, is held out. A word is a class
    given the state, and a word given the class: frequent words by the state again, the
    others by their share of their form class, in which words never seen have the weight
    of one type. The state goes through the whole text.

    Counts, vocabulary and training cover all documents that are not held out; only the
    start of the training is a bounded sample. Frequent words and form classes, both of
    fixed number, and the weights are all that the driver sees.

    A NULL text is empty and has the end alone; a NULL doc_id is not held out; rows that
    repeat a document are each counted and scored. If nothing is there to learn from, no
    word is known. An empty table gives an empty result; extra columns are left out.
    """
    batches_ = saved(encoded(docs), "tokens")
    words = word_rows(batches_)
    totals = saved(words.where("n > 0").groupBy("h").agg(F.sum("n").alias("c")), "word-counts")
    n_tokens, n_words = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = [(r["h"], r["c"]) for r in totals.orderBy(F.col("c").desc(), "h").limit(FREQUENT).collect()]
    by_form = totals.groupBy(F.col("h").bitwiseAND(255).alias("form")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()
    masses = {r["form"]: r["c"] + ADD * r["types"] for r in by_form}
    for h, c in frequent:
        masses[h & 255] -= c + ADD
    vocabulary = Vocabulary.of(frequent, masses)
    weights = fit(batches_, vocabulary)
    log_rest = float(np.log10(n_tokens + ADD * (n_words + 1)))

    def score(rows: pa.Table, counts: pa.Table) -> pa.Table:
        batch = rows.combine_chunks().to_batches()[0]
        words = _array(batch.column("words"), 0, np.uint64)
        tokens, sizes = _array(batch.column("tokens"), 0, np.uint32), _array(batch.column("sizes"), 0, np.int64)
        c = np.zeros(len(words))
        c[counts.column("place").to_numpy()] = counts.column("c").to_numpy()
        ids = vocabulary.ids(words)
        form = np.maximum(ids - len(vocabulary.hashes), 0)
        inside = np.where(ids < len(vocabulary.hashes), 0.0, np.log((c + ADD) / vocabulary.masses[form]))
        ids, held, there = ids.astype(np.uint16), _array(batch.column("held"), 0, bool), _array(batch.column("there"), 0, bool)
        base, known, doc_ids = np.log10(c + ADD) - log_rest, (c > 0).astype(np.int64), _array(batch.column("doc_ids"), 0, np.int64)
        done, parts = 0, []
        for own in _text_parts(sizes, PART_TOKENS):
            size = sizes[own]
            first = np.cumsum(size) - size
            token = tokens[done : done + size.sum()]
            model = token_scores(weights, vocabulary, ids[token], size, inside[token]) / _LOG10
            columns = {
                "doc_id": pa.array(doc_ids[own], mask=~there[own]), "held_out": pa.array(held[own]),
                "n_tokens": size, "n_known": np.add.reduceat(known[token], first),
                "train_tokens": np.full(len(size), n_tokens, np.int64),
                "base_score": np.add.reduceat(base[token], first), "score": np.add.reduceat(model, first),
            }
            parts.append(pa.table(columns))
            done += len(token)
        return pa.concat_tables(parts)

    counted = words.select("batch", "place", "h").join(totals, "h").select("batch", "place", "c")
    return (
        batches_.drop("taught").groupBy("batch").cogroup(counted.groupBy("batch"))
        .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
