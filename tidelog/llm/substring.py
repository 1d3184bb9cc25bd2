"""Substring de-duplication over sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import WHITE, saved

# A span is the shortest run of sentences with at least this many words. A sentence ends
# with its punctuation or line. Longer ones than SENTENCE_WORDS are cut in front of the
# smallest hash of every CUT_WORDS consecutive words, so that cuts depend on the words
# within CUT_WORDS only, and SPAN_WORDS before their end, so that spans reach it. Equal
# passages inside long sentences share a span from 45 words on wherever they start, from
# 58 on where the sentence of one ends with the passage or a few words later.
SPAN_WORDS = 20
SENTENCE_WORDS = 16
CUT_WORDS = 7

# Characters of texts that are looked at together.
CHUNK = 1 << 17

_NULL_DOC = -(1 << 63)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE_FACTOR = 0xE7037ED1A0B428DB
_WORD_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTES = np.random.RandomState(21).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_IS_SPACE = np.isin(np.arange(256), list(WHITE.encode()))
_IS_END = np.isin(np.arange(256), list(b".!?"))


def _split(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, one per line and more, with A-Z in lower case, begin and end of the words
    there, the words' hashes, where sentences begin among the words, and where texts begin
    among the sentences; the last two followed by the number of words or sentences."""
    parts = [(t or "").encode().lower() for t in texts]
    lower = b"\n".join(parts)
    data = np.frombuffer(lower, np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[data], prepend=True, append=True))
    words = edges.reshape(-1, 2)
    hashes = _run_hashes(_BYTES[data], words[:, 0], words[:, 1], _BYTE_FACTOR)
    lines = np.cumsum(data == 10)
    last = words[:, 1] - 1
    ended = _IS_END[data[last]]
    ended[:-1] |= lines[last[:-1]] != lines[words[1:, 0]]
    ended[-1:] = True
    ends = np.concatenate([[0], np.flatnonzero(ended) + 1])
    cut = np.zeros(len(words) + 1, bool)
    cut[ends] = True
    sizes = np.diff(ends)
    cut[ends[1:][sizes > SPAN_WORDS] - SPAN_WORDS] = True
    # windows that reach beyond their sentence, or are in a short one, do not count
    here = np.repeat(np.where(sizes > SENTENCE_WORDS, ends[1:], 0), sizes)
    at = np.flatnonzero(np.arange(CUT_WORDS, len(words) + CUT_WORDS) <= here)
    low, least = at, hashes[at]
    for k in range(1, CUT_WORDS):  # of equal hashes the last one
        value = hashes[at + k]
        smaller = value <= least
        low, least = np.where(smaller, at + k, low), np.where(smaller, value, least)
    cut[low] = True
    places = np.flatnonzero(cut)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    return lower, words, hashes, places, np.searchsorted(places, np.searchsorted(words[:, 0], begins))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts that are small together, or one text."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > CHUNK:
            yield begin, k
            begin, size = k, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence, A-Z in lower case; lines and sentences without words
    do not count."""
    lower, words, _, places, _ = _split([text])
    return [[lower[x:y] for x, y in words[a:b]] for a, b in zip(places, places[1:])]


def _char_places(text: str, places: np.ndarray) -> list[tuple[int, int]]:
    words = [m.span() for m in _WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b in zip(places, places[1:])]


def sentence_places(text: str) -> list[tuple[int, int]]:
    """Begin and end of the same sentences, in characters of the text."""
    return _char_places(text, _split([text])[3])


def span_ends(sizes: np.ndarray, span_words: int) -> np.ndarray:
    """For each sentence the end (exclusive) of the span that starts there; beyond the
    number of sentences where too few words follow."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.searchsorted(total, total[:-1] + span_words, "left")


def _powers(factor: int, n: int) -> np.ndarray:
    powers = np.full(n, factor, np.uint64)
    if n:
        powers[0] = 1
    return np.multiply.accumulate(powers)


def _run_hashes(plain: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """A hash of each run of ``plain``: sums of its hashes times powers of a factor, so
    that a run's hash is a difference of running sums."""
    mixed = (plain ^ (plain >> np.uint64(29))) * np.uint64(factor)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(factor, len(plain)), dtype=np.uint64)])
    back = _powers(pow(factor, -1, 1 << 64), len(plain) + 1)
    value = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    return value ^ (value >> np.uint64(32))


def span_hashes(words: np.ndarray, places: np.ndarray, firsts: np.ndarray, span_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all spans within a text and two hashes of each, over the sentences'
    hashes, which are over those of their words."""
    ends = span_ends(np.diff(places), span_words)
    starts = np.flatnonzero(ends <= np.repeat(firsts[1:], np.diff(firsts)))
    ends = ends[starts]
    hashes = [_run_hashes(_run_hashes(words, places[:-1], places[1:], other), starts, ends, factor) for factor, other in zip(_FACTORS, _WORD_FACTORS)]
    return starts, hashes[0], hashes[1]


def spans(docs: DataFrame, span_words: int) -> DataFrame:
    """``h, g, doc, at``: hashes of every span, and where it starts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            docs_, texts = batch.column("doc_id").fill_null(_NULL_DOC).to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for begin, end in _chunks(texts):
                _, _, words, places, firsts = _split(texts[begin:end])
                at, h, g = span_hashes(words, places, firsts, span_words)
                k = np.searchsorted(firsts, at, "right") - 1
                parts.append((h.view(np.int64), (g & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), docs_[begin:end][k].astype(np.int64), (at - firsts[k]).astype(np.int32)))
            h, g, doc, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32))
            yield pa.RecordBatch.from_pydict({"h": h, "g": g, "doc": doc, "at": at})

    return docs.select("doc_id", "text").mapInArrow(hashed, "h long, g int, doc long, at int")


def without(text: str, gone: list[int], places: np.ndarray, span_words: int) -> tuple[str, int]:
    """The text without the sentences of the spans that start at ``gone``, and their
    number. White space after a removed sentence goes with it."""
    ends = span_ends(np.diff(places), span_words)
    places = _char_places(text, places)
    removed = np.zeros(len(places) + 1, np.int64)
    for at in gone:
        removed[at] += 1
        removed[ends[at]] -= 1
    covered = np.cumsum(removed[:-1]) > 0
    kept, last = [], 0
    for k in np.flatnonzero(covered):
        begin = places[k][0]
        end = places[k + 1][0] if k + 1 < len(places) else len(text)
        kept.append(text[last:begin])
        last = end
    kept.append(text[last:])
    left = "".join(kept)
    return (left.rstrip(WHITE) if covered[-1] else left), int(covered.sum())


def dedup_spans(docs: DataFrame, span_words: int = SPAN_WORDS) -> DataFrame:
    """``doc_id, n_sentences, n_removed, copied_from, text`` for every document.

    Each run of consecutive sentences with at least ``span_words`` words is hashed and
    compared with all others. Of a span that occurs several times the first occurrence,
    by doc_id and place, stays; sentences that any other occurrence covers are removed.
    ``copied_from`` lists the documents with the first occurrences.

    White space and the case of A-Z do not count. NULL texts stay NULL, texts with fewer
    words than a span stay as they are. A NULL doc_id counts as the smallest. Rows that
    share a doc_id are one document: a text that repeats under its own doc_id is its own
    first occurrence and stays. An empty table gives an empty result; extra columns are
    left out.
    """
    all_spans = spans(docs, span_words)
    # a frequent span is few rows before the shuffle, and its occurrences are dealt out
    # by the join, which splits heavy keys
    repeated = all_spans.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h", "g")
    again = saved(all_spans.join(repeated, ["h", "g"]), "spans")
    first = again.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"))
    later = again.join(first, ["h", "g"]).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    hits = later.groupBy(F.col("doc").alias("s_doc")).agg(
        F.collect_set("at").alias("s_at"), F.array_sort(F.collect_set("first.doc")).alias("s_from")
    )
    found = docs.select("doc_id", "text").join(hits, F.coalesce("doc_id", F.lit(_NULL_DOC)) == F.col("s_doc"), "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed = [], [], []
            whole, hit = batch.column("text").to_pylist(), batch.column("s_at").to_pylist()
            for begin, end in _chunks(whole):
                *_, all_places, firsts = _split(whole[begin:end])
                sizes += np.diff(firsts).tolist()
                for k in range(begin, end):
                    text, gone, a, b = whole[k], hit[k], firsts[k - begin], firsts[k - begin + 1]
                    if gone:
                        # rows that share a doc_id may be shorter than the one that was hit
                        places = all_places[a : b + 1] - all_places[a]
                        ends = span_ends(np.diff(places), span_words)
                        gone = [at for at in gone if at < len(ends) and ends[at] < len(places)]
                    left, n = without(text, gone, places, span_words) if gone else (text, 0)
                    texts.append(left)
                    removed.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), batch.column("s_from"), pa.array(texts, pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "copied_from", "text"],
            )

    return found.select("doc_id", "text", "s_at", "s_from").mapInArrow(
        clean, "doc_id long, n_sentences long, n_removed long, copied_from array<long>, text string"
    )
