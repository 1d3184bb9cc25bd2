"""SentencePiece ids with the original bytes of every piece, and back to text.

Normalisation replaces, at each place, the longest prefix that the model's compiled
character map knows, and records for every normalised byte where it came from. The
normalised text is cut into pieces by the model's own merges; the record then projects
every piece to a span of original bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The mark that stands for a space, the field numbers of a model file and
# the kinds of pieces that are told apart.
MARK = "▁".encode()
_PIECES, _NORMALIZER = 1, 3
_CHARSMAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5
_PIECE_KIND, _USER_DEFINED = 3, 4

# Texts are handed to the model in portions of about so many characters.
_PORTION = 1 << 20

PIECE_SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: numbers and byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """The compiled map of a model: a double-array trie whose leaves point to
    replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist() if compiled else []
        self.replacements = compiled[4 + size :]
        self.firsts = bytes(b for b in range(256) if self.units and self._child(self._root(), b) is not None)

    def _base(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _root(self) -> int:
        return self._base(self.units[0])

    def _child(self, node: int, byte: int) -> int | None:
        place = node ^ byte
        return place if place < len(self.units) and self.units[place] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data[at:]``."""
        node, found = self._root(), None
        for size, byte in enumerate(data[at : at + 64], 1):
            place = self._child(node, byte)
            if place is None:
                break
            unit = self.units[place]
            node = place ^ self._base(unit)
            if unit >> 8 & 1:
                found = size, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, start = found
        return size, self.replacements[start : self.replacements.index(0, start)]


def _char_size(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """A model's normalisation. ``of`` gives the normalised bytes and, for each of them
    and for the end, the place in the original bytes it came from."""

    def __init__(self, spec: bytes):
        values = dict(_fields(spec))
        self.map = CharacterMap(values.get(_CHARSMAP, b""))
        self.prefix = bool(values.get(_DUMMY_PREFIX, 1))
        self.squeeze = bool(values.get(_REMOVE_EXTRA, 1))
        self.space = MARK if values.get(_ESCAPE, 1) else b" "
        known = b"[" + b"".join(b"\\x%02x" % b for b in self.map.firsts) + b"]"
        self.candidate = re.compile(known) if self.map.firsts else None

    def of(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int32)
        if self.squeeze or (self.candidate and self.candidate.search(data)):
            return self._by_character(data)
        head = self.space if self.prefix else b""
        source = np.frombuffer(data, np.uint8)
        widths = np.where(source == 0x20, len(self.space), 1)
        places = np.repeat(np.arange(len(data), dtype=np.int32), widths)
        places = np.concatenate([np.zeros(len(head), np.int32), places, np.array([len(data)], np.int32)])
        return head + data.replace(b" ", self.space), places

    def _next(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at) if self.candidate and data[at] in self.map.firsts else None
        if found:
            return found
        size = _char_size(data[at])
        return size, data[at : at + size]

    def _by_character(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, out, places = 0, bytearray(), []
        if self.squeeze:
            while at < len(data):
                size, value = self._next(data, at)
                if value != b" ":
                    break
                at += size
            if at == len(data):
                return b"", np.zeros(1, np.int32)
        if self.prefix:
            out += self.space
            places += [at] * len(self.space)
        after_space = self.squeeze
        while at < len(data):
            size, value = self._next(data, at)
            if after_space:
                value = value.lstrip(b" ")
            if value:
                shown = value.replace(b" ", self.space)
                out += shown
                places += [at] * len(shown)
                after_space = self.squeeze and value.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(self.space):
                at = places[len(out) - len(self.space)]
                del out[-len(self.space) :], places[-len(self.space) :]
        return bytes(out), np.array([*places, at], np.int32)


class PieceCodec:
    """A model with byte fallback, read from a file that every executor has."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        fields = list(_fields(model))
        if any(dict(_fields(v)).get(_PIECE_KIND) == _USER_DEFINED for k, v in fields if k == _PIECES):
            raise ValueError("models with user-defined pieces are not supported")
        self.normalizer = Normalizer(b"".join(v for k, v in fields if k == _NORMALIZER))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        if not any(self.model.is_byte(i) for i in range(size)):
            raise ValueError("the model needs byte fallback: an unknown piece has no length of its own")
        # the merges alone: a later field of a message wins over an earlier one
        plain = b"".join(bytes([key << 3, value]) for key, value in ((_DUMMY_PREFIX, 0), (_REMOVE_EXTRA, 0), (_ESCAPE, 0)))
        without_map = bytes([_CHARSMAP << 3 | 2, 0]) + plain
        self.merges = sentencepiece.SentencePieceProcessor(
            model_proto=model + bytes([_NORMALIZER << 3 | 2, len(without_map)]) + without_map
        )
        self.sizes = np.array([len(self.model.id_to_piece(i).encode()) for i in range(size)], np.int32)
        self.bytes = np.full(size, -1, np.int32)
        for i in range(size):
            if self.model.is_byte(i):
                self.bytes[i] = int(self.model.id_to_piece(i)[3:5], 16)
        self.char_sizes = np.array([_char_size(b) for b in range(256)], np.int32)

    def _widths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of every piece. Of the byte pieces that spell a character the
        last one has all of its bytes."""
        widths, spelled = self.sizes[ids], np.flatnonzero(self.bytes[ids] >= 0)
        if len(spelled):
            widths[spelled] = 0
            values = self.bytes[ids[spelled]]
            leads = (values < 0x80) | (values >= 0xC0)
            size = self.char_sizes[values[leads]]
            widths[spelled[leads] + size - 1] = size
        return widths

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and first and last original byte (exclusive) of every piece, per text."""
        normal = [self.normalizer.of((text or "").encode()) for text in texts]
        found = self.merges.encode([data for data, _ in normal], num_threads=1, return_type="numpy")
        for ids, (data, places) in zip(found, normal):
            ends = np.cumsum(self._widths(ids), dtype=np.int64)
            if int(ends[-1] if len(ends) else 0) != len(data):
                raise ValueError("the pieces do not cover the normalised text")
            begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ids)]
            yield ids, places[begins], places[ends]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.model.decode(ids) if ids else []


def _portions(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Runs ``(first, end)`` of rows, each of about ``_PORTION`` or one large row."""
    first = total = end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= _PORTION:
            yield first, end
            first, total = end, 0
    if end > first:
        yield first, end


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, begins, ends`` of every row of ``docs``: the ids of its whole text and
    for each the original UTF-8 bytes ``[begin, end)`` it stands for. Of the byte pieces
    that spell a character the last one has its span, those before it an empty one; the
    piece of the leading mark alone is empty too.

    A NULL text is empty and has no ids; a NULL doc_id is kept; rows that repeat a
    document are encoded each; an empty table gives an empty result; extra columns are
    left out. Very long texts are encoded as a whole, one at a time. Texts never meet, so
    nothing is shuffled and a lost executor costs its own tasks only.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            sizes = batch.column("text").cast(pa.large_string())
            lengths = (0 if not v.is_valid else len(v.as_buffer()) for v in sizes)
            for first, end in _portions(lengths):
                part = batch.slice(first, end - first)
                columns = list(zip(*codec.encode(part.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *[_lists(list(c)) for c in columns]],
                    names=["doc_id", "ids", "begins", "ends"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, PIECE_SCHEMA)


def decode_pieces(pieces: DataFrame, model: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of the ids in ``column``. NULL ids give NULL, no ids an empty text;
    bytes that are no UTF-8 become replacement characters, as the model does it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    if into.lower() in {c.lower() for c in pieces.columns}:
        raise ValueError(f"there is a column {into!r} already")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            sizes = batch.column(column).value_lengths().fill_null(0).to_pylist()
            for first, end in _portions(4 * n for n in sizes):
                part = batch.slice(first, end - first)
                ids = part.column(column)
                values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                lengths = ids.value_lengths().drop_null().to_numpy(zero_copy_only=False)
                texts = iter(codec.decode(np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []))
                shown = pa.array([next(texts) if there else None for there in ids.is_valid().to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, shown], names=[*part.schema.names, into])

    return pieces.mapInArrow(decode, f"{schema}, `{into}` string")
