"""Packing and mixing: round trips and plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import doc
from tidelog.llm.mixing import SCHEDULES, mix, mix_documents, source_targets, time_of_demand
from tidelog.llm.packing import WordIds, linear_groups, pack, plan
from tidelog.llm.queries import tokenizer_path

# --- packing ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_word_by_word_ids_are_those_of_the_text(tokenizer):
    texts = [
        "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x y　z\u0085w á ́b café", "don't WE'LL 1234 ½ ²³ 😀👍🏽",
        "  q \x1c r\x1fs \x00", "", None, "ＦＵＬＬ İstanbul ẞ ǅ", "a" * 5000 + " " + "é1!" * 300, "\n\t\x0b one \r\n two",
    ]
    words = WordIds(tokenizer_path())
    for _ in range(2):  # the second time from memory
        found = [np.frombuffer(x, "<u4").tolist() for x in words.of(texts)]
        assert found == [ids_of(tokenizer, t)[:-1] for t in texts]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_are_whole_and_gapless(frame, corpus, tokenizer, capacity):
    rows = pack(frame(corpus).selectExpr("*", "1 AS piece", "2 AS rank", "3 AS block"), tokenizer_path(), capacity, with_ids=True).collect()
    expected = Counter()
    for i, text, *_ in corpus:
        ids = ids_of(tokenizer, text)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4").tobytes()
            expected[(i, piece, at, len(own) // 4, zlib.crc32(own), own)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= math.ceil(total / capacity) * 1.1 + 2


def test_packing_of_no_rows_and_of_empty_texts(frame):
    assert pack(frame([doc(1, "a")]).limit(0), tokenizer_path()).count() == 0
    rows = pack(frame([doc(i, None) for i in range(3000)]), tokenizer_path()).collect()
    assert {r["length"] for r in rows} == {1} and {r["sequence_id"] for r in rows} == {0, 1}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    draw = [lambda: rng.randint(1, 2048), lambda: min(2048, int(rng.lognormvariate(6, 1)) + 1), lambda: rng.choice([700, 683, 682, 1024, 1025, 300])][seed % 3]
    counts = Counter(draw() for _ in range(4000))
    made = plan(dict(counts))
    used, placed = defaultdict(list), Counter()
    for length, rank, n, sequence, offset in made.slots:
        for k in range(n):
            used[sequence + k].append((offset, length))
            placed[length, rank + k] += 1
    assert placed == Counter({(length, r): 1 for length, n in counts.items() for r in range(n)})
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    bound = max(math.ceil(sum(k * n for k, n in counts.items()) / 2048), sum(n for k, n in counts.items() if k > 1024))
    assert set(used) == set(range(made.sequences)) and made.sequences <= bound * 1.06 + 3


def test_groups_have_equal_cardinality():
    groups = linear_groups({900: 10, 800: 5, 700: 30}, 9)
    assert [sum(n for _, n in parts) for _, parts in groups] == [5] * 9
    assert all(size == max(x for x, _ in parts) for size, parts in groups)


def test_the_plan_does_not_grow_with_the_pieces():
    counts = {k: 3 + k % 7 for k in range(1, 2049)}
    small, large = plan(counts), plan({k: n * 1000 for k, n in counts.items()})
    assert len(large.slots) < 4 * len(small.slots) + 20_000


# --- mixing ---------------------------------------------------------------------------------

def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, goal = 1.5 * sum(sizes.values()), {}
    free = set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            goal |= {s: level * weight[s] for s in free}
            break
        for s in full:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        free -= full
    return goal


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_match_repeated_sharing(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 40):
        sizes = {None if k == 3 else f"s{k}é": rng.choice([0, 5, 100, 10_000, 300_000]) for k in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r["m_source"]: r["target"] for r in source_targets(df).collect()}
        expected = plain_targets(sizes)
        assert found.keys() == expected.keys()
        assert all(math.isclose(found[s], expected[s], rel_tol=1e-9, abs_tol=1e-9) for s in found)


def test_mix_takes_its_targets(frame, corpus):
    rows = mix(frame(corpus).selectExpr("*", "1 AS size", "2 AS weight", "3 AS target", "4 AS `order`")).collect()
    assert len(rows) == len(corpus)
    size = defaultdict(int)
    for _, t, _, s, _ in corpus:
        size[s] += words(t)
    goal = plain_targets(size)
    again = mix(frame(corpus, partitions=7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
    assert {round(k[1], 6): v for k, v in taken.items()} == {round(goal[s], 6): math.floor(goal[s]) for s in goal}
    shown = [r["position"] for r in rows if r["position"] is not None]
    assert shown == sorted(shown) and 0 <= shown[0] and shown[-1] <= 1


def test_mixed_documents_are_whole(frame, corpus):
    clash = frame(corpus).selectExpr("*", "1 AS row", "2 AS take", "3 AS content")
    rows = mix_documents(clash)
    assert rows.columns == clash.columns
    found = Counter((r["doc_id"], r["text"]) for r in rows.collect())
    given = Counter((i, t) for i, t, *_ in corpus)
    assert all(n <= 2 * given[k] for k, n in found.items())
    size, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s, _ in corpus:
        size[s] += words(t)
    for r in rows.collect():
        taken[r["source"]] += words(r["text"])
    goal = plain_targets(size)
    longest = defaultdict(int)
    for _, t, _, s, _ in corpus:
        longest[s] = max(longest[s], words(t))
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in goal)
    assert mix(clash.limit(0)).count() == 0 and mix_documents(clash.limit(0)).count() == 0


@pytest.mark.parametrize("weight", sorted(SCHEDULES))
def test_times_invert_the_integrated_schedule(spark, weight):
    schedule = SCHEDULES[weight]
    parts = [k / 50 for k in range(51)]
    df = spark.createDataFrame([(x,) for x in parts], "part double")
    times = [r[0] for r in df.select(time_of_demand(F.col("part"), schedule)).collect()]
    knots_t, knots_w = zip(*schedule)
    grid = np.linspace(0, 1, 20_001)
    density = np.interp(grid, knots_t, knots_w)
    total = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(grid))])
    assert np.allclose(np.interp(times, grid, total / total[-1]), parts, atol=1e-4)


def test_sources_fade_as_scheduled(frame):
    rng = random.Random(2)
    rows = [doc(i, "w " * rng.randint(5, 15), f"s{i % 3}") for i in range(3000)]
    shown = defaultdict(list)
    source = {i: s for i, _, _, s, _ in rows}
    for r in mix(frame(rows)).collect():
        if r["position"] is not None:
            shown[source[r["doc_id"]]].append(r["position"])
    early = {s: np.mean(np.array(x) < 0.5) for s, x in shown.items()}
    assert early["s0"] > early["s1"] > early["s2"]


def test_order_is_by_checksum_of_the_id(frame):
    rows = [doc(i, "w " * 10, "only") for i in range(200)]
    found = mix(frame(rows), weights=(1.0,), share=0.5, schedules={1.0: ((0.0, 1.0), (1.0, 1.0))}).where("taken > 0").collect()
    expected = sorted(range(200), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:100]
    assert [r["doc_id"] for r in found] == expected
