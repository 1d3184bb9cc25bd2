"""Line de-duplication: documents probe a sharded minimal perfect hash of frequent lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import WHITE, free_name, saved

# A line is removed when its key has this many characters and this many documents hold it.
MIN_CHARS = 40
MIN_DOCS = 5

# Keys per shard, and how many bytes of arrays are sent to every executor at most. Beyond
# them the lines go to the shards instead.
SHARD_KEYS = 1 << 17
BROADCAST_BYTES = 64 << 20
ENTRY_BYTES = 32
_SALTS = 32

_SPACE_BYTES = WHITE.encode()
_NULL_DOC = -(1 << 63)


# --- minimal perfect hash -------------------------------------------------------------

def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the keys for each level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Levels of bits: a key sits at the first level where no other key shares its bit,
    and its number is the count of set bits before that one."""

    sizes: list[int]
    bits: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def build(keys: np.ndarray, room: float = 2.0) -> "PerfectHash":
        sizes, parts, rest = [], [], np.unique(keys)
        while len(rest):
            size = int(len(rest) * room) + 1
            place = (_spread(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            rest = rest[~alone[place]]
        return PerfectHash.of(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    @staticmethod
    def of(sizes: list[int], bits: np.ndarray) -> "PerfectHash":
        return PerfectHash(sizes, bits, np.cumsum(bits, dtype=np.int64) - bits)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that certainly were not there."""
        found = np.full(len(keys), -1, np.int64)
        open_, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            place = start + (_spread(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place]
            found[open_[hit]] = self.ranks[place[hit]]
            open_, start = open_[~hit], start + size
        return found


@dataclass
class Shard:
    """Arrays of one shard, in the order of the perfect hash: fingerprint, number of
    documents and the document that keeps the line."""

    index: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    owners: np.ndarray

    @staticmethod
    def from_row(row) -> "Shard":
        sizes = np.frombuffer(row["sizes"], np.int64).tolist()
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        return Shard(
            PerfectHash.of(sizes, bits), np.frombuffer(row["prints"], np.int64),
            np.frombuffer(row["counts"], np.int64), np.frombuffer(row["owners"], np.int64),
        )

    def probe(self, keys: np.ndarray, prints: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which occurrences go: the line is in the shard and another document keeps it."""
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        number = self.index.numbers(keys.view(np.uint64))
        known = np.maximum(number, 0)
        return (number >= 0) & (self.prints[known] == prints) & (self.owners[known] != docs)


SHARD_SCHEMA = "shard long, sizes binary, bits binary, prints binary, counts binary, owners binary"


def _shard_row(key, rows):
    import pandas as pd

    keys = rows["h"].to_numpy(np.int64)
    index = PerfectHash.build(keys.view(np.uint64))
    number = index.numbers(keys.view(np.uint64))
    arrays = {}
    for name, column in (("prints", "fp"), ("counts", "n"), ("owners", "owner")):
        arrays[name] = np.zeros(len(keys), np.int64)
        arrays[name][number] = rows[column].to_numpy(np.int64)
    return pd.DataFrame(
        {
            "shard": [key[0]], "sizes": [np.array(index.sizes, np.int64).tobytes()],
            "bits": [np.packbits(index.bits).tobytes()], **{k: [v.tobytes()] for k, v in arrays.items()},
        }
    )


# --- documents --------------------------------------------------------------------------

def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _line_hashes(lines: list[str], min_chars: int) -> tuple[list[int], list[bytes]]:
    """Numbers of the lines whose key is long enough, and the keys' 128-bit hashes."""
    places, digests = [], []
    for i, line in enumerate(lines):
        key = line.strip(WHITE)
        if len(key) >= min_chars:
            places.append(i)
            digests.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes: only A-Z change
    return places, digests


def _doc_ids(batch: pa.RecordBatch) -> list[int]:
    return [_NULL_DOC if x is None else x for x in batch.column("doc_id").to_pylist()]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_counts(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``h, fp, n, owner`` of the lines in at least ``min_docs`` documents. Each batch of
    documents first counts for itself, so that a line in a third of all documents is few
    rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for doc, text in zip(_doc_ids(batch), batch.column("text").to_pylist()):
                for digest in set(_line_hashes(_lines(text), min_chars)[1]):
                    entry = seen.get(digest)
                    if entry is None:
                        seen[digest] = [1, doc]
                    else:
                        entry[0] += 1
                        entry[1] = max(entry[1], doc)
            h, fp = _halves(list(seen))
            n, owner = np.array(list(seen.values()), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_pydict({"h": h, "fp": fp, "n": pa.array(n.copy()), "owner": pa.array(owner.copy())})

    counted = docs.select("doc_id", "text").mapInArrow(count, "h long, fp long, n long, owner long")
    totals = counted.groupBy("h", "fp").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))
    return totals.where(F.col("n") >= min_docs)


def build_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The shards as rows, their number and the number of keys. A key's shard follows
    from its hash, so shards are even."""
    counts = saved(counts, "line-counts")
    n_keys = counts.count()
    n_shards = max(1, -(-n_keys // shard_keys))
    placed = counts.withColumn("shard", F.pmod("h", F.lit(n_shards).cast("long")))
    return saved(placed.groupBy("shard").applyInPandas(_shard_row, SHARD_SCHEMA), "line-index"), n_shards, n_keys


def _cleaned(batch: pa.RecordBatch, gone_of) -> tuple[list[int], list[int], list[str | None]]:
    """Lines, dropped lines and what is left of every text of a batch."""
    texts, ids = batch.column("text").to_pylist(), _doc_ids(batch)
    all_lines = [_lines(t) for t in texts]
    places, digests, owner_rows = [], [], []
    for row, lines in enumerate(all_lines):
        p, d = _line_hashes(lines, gone_of.min_chars)
        places += p
        digests += d
        owner_rows += [row] * len(p)
    dropped: dict[int, set[int]] = {}
    if digests:
        h, fp = _halves(digests)
        rows = np.array(owner_rows)
        gone = gone_of(h, fp, np.array(ids, np.int64)[rows])
        for i in np.flatnonzero(gone):
            dropped.setdefault(owner_rows[i], set()).add(places[i])
    left = [
        "\n".join(x for i, x in enumerate(lines) if i not in dropped[row]) if row in dropped else text
        for row, (lines, text) in enumerate(zip(all_lines, texts))
    ]
    return [len(x) for x in all_lines], [len(dropped.get(i, ())) for i in range(len(texts))], left


class _Probe:
    """Probes the arrays of all shards, which each worker unpacks once."""

    def __init__(self, broadcast, n_shards: int, min_chars: int):
        self.broadcast, self.n_shards, self.min_chars, self.shards = broadcast, n_shards, min_chars, None

    def __call__(self, h: np.ndarray, fp: np.ndarray, docs: np.ndarray) -> np.ndarray:
        if self.shards is None:
            self.shards = {row["shard"]: Shard.from_row(row) for row in self.broadcast.value}
        gone, shard = np.zeros(len(h), bool), h % self.n_shards
        for number in np.unique(shard):
            if number in self.shards:
                mine = np.flatnonzero(shard == number)
                gone[mine] = self.shards[number].probe(h[mine], fp[mine], docs[mine])
        return gone


def _probed_by_shard(docs: DataFrame, index: DataFrame, n_shards: int, min_chars: int) -> DataFrame:
    """The documents and the hashes of their lines that go, found where the shards lie. Lines are dealt by shard and salt; each salt gets the shard's arrays."""
    import pandas as pd

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids = [], []
            for doc, text in zip(_doc_ids(batch), batch.column("text").to_pylist()):
                own = set(_line_hashes(_lines(text), min_chars)[1])
                digests += own
                ids += [doc] * len(own)
            h, fp = _halves(digests)
            yield pa.RecordBatch.from_pydict({"doc": pa.array(ids, pa.int64()), "h": h, "fp": fp, "shard": h % n_shards})

    lines = docs.select("doc_id", "text").mapInArrow(rows, "doc long, h long, fp long, shard long")
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(_SALTS)))
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))

    def probe(key, own, arrays):
        if arrays.empty or own.empty:
            return pd.DataFrame({"doc": [], "h": []}, dtype="int64")
        gone = Shard.from_row(arrays.iloc[0]).probe(*(own[c].to_numpy(np.int64) for c in ("h", "fp", "doc")))
        return own.loc[gone, ["doc", "h"]]

    hits = lines.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(probe, "doc long, h long")
    return hits.groupBy("doc").agg(F.collect_set("h").alias("lines"))


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    statistics: bool = False,
    shard_keys: int = SHARD_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Documents without lines that many documents share.

    The key of a line is the line without ASCII white space at both ends, A-Z in lower
    case. Lines with a key of at least ``min_chars`` characters that at least ``min_docs``
    documents hold go from all documents but the one with the largest doc_id. The
    frequent keys lie in shards, each a minimal perfect hash over arrays of fingerprints,
    counts and keepers; documents probe these arrays, and lines are never joined. Up to
    ``broadcast_bytes`` the arrays go to all executors; larger ones are probed where the
    shards lie, with the same result.

    All columns stay. ``statistics`` puts ``doc_id, n_lines, n_dropped, text`` in their
    place. NULL and empty texts have one empty line and stay as they are; a NULL doc_id
    counts as the smallest. Every row is a document, so a row that repeats one counts
    again, and all rows with the largest doc_id keep the line. No rows give no rows.
    """
    spark = docs.sparkSession
    index, n_shards, n_keys = build_index(line_counts(docs, min_chars, min_docs), shard_keys)
    columns = ["doc_id", "text"] if statistics else docs.columns
    schema = "doc_id long, n_lines long, n_dropped long, text string" if statistics else docs.schema

    def result(batch: pa.RecordBatch, probe) -> pa.RecordBatch:
        n_lines, n_dropped, texts = _cleaned(batch, probe)
        texts = pa.array(texts, pa.string())
        if statistics:
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_lines": n_lines, "n_dropped": n_dropped, "text": texts})
        new = {"text": texts}
        if "n_chars" in columns:
            old = batch.column("n_chars").to_pylist()
            sizes = [len(t) if d else o for t, d, o in zip(texts.to_pylist(), n_dropped, old)]
            new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)

    if n_keys * ENTRY_BYTES <= broadcast_bytes:
        probe = _Probe(spark.sparkContext.broadcast([r.asDict() for r in index.collect()]), n_shards, min_chars)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield result(batch, probe)

        return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(clean, schema)

    hit_doc, hit_lines = (free_name(columns, c) for c in ("hit_doc", "hit_lines"))
    hits = _probed_by_shard(docs, index, n_shards, min_chars).toDF(hit_doc, hit_lines)
    same = F.coalesce("doc_id", F.lit(_NULL_DOC)) == F.col(hit_doc)
    found = docs.select(*[F.col(f"`{c}`") for c in columns]).join(hits, same, "left").drop(hit_doc)

    def clean_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = {d: set(x) for d, x in zip(_doc_ids(batch), batch.column(hit_lines).to_pylist()) if x}

            def told(h, fp, ids):
                return np.array([x in gone.get(d, ()) for x, d in zip(h.tolist(), ids.tolist())], bool)

            told.min_chars = min_chars
            yield result(batch, told)

    return found.mapInArrow(clean_hits, schema)
