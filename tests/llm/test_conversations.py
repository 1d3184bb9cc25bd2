"""Repaired conversations against a plain version of its own."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidelog.llm import conversation_repair
from tidelog.llm.conversation_repair import Grammar, damage, in_order, least_edits, repair, repair_report
from tidelog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
FULL = {"u": "user", "a": "assistant"}
PAIRS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least cost, least audit of that cost and the rows it leaves; ``rows`` are role,
    text, whether it must go, whether it is cut."""
    n = len(rows)

    def ways(i, state):
        for role in "ua":
            if (state, role) in PAIRS:
                yield 5, "I", i, role, [(FULL[role], "")]
        if i < n:
            role, text, must, cut = rows[i]
            yield 2, "D", i + 1, state, []
            if not must:
                more = 5 if cut else 0
                if (state, role[:1]) in PAIRS:
                    yield more, "K", i + 1, role[:1], [(role, text)]
                for new in "ua":
                    if (state, new) in PAIRS:
                        yield 1 + more, "R", i + 1, new, [(FULL[new], text)]

    cost = {(n, s): 0 if s in ("", "a") else 10**9 for s in ("", "s", "u", "a")}
    for i in range(n, -1, -1):
        for s in ("", "s", "u", "a"):
            cost.setdefault((i, s), 10**9)
        for _ in range(4):
            for s in ("", "s", "u", "a"):
                cost[i, s] = min([cost[i, s], *(c + cost[j, t] for c, _, j, t, _ in ways(i, s))])

    @lru_cache(None)
    def least(i, s):
        found = [("", ())] if i == n and s in ("", "a") and not cost[i, s] else []
        for c, edit, j, t, made in ways(i, s):
            if c + cost[j, t] == cost[i, s]:
                audit, left = least(j, t)
                found.append((edit + audit, tuple(made) + left))
        return min(found)

    return cost[0, ""], *least(0, "")


def order(row):
    return row[1] is not None, row[1] or 0, row[2], row[3]


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        found.append("blank" if not solid else "duplicate" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def plain(rows):
    conversations = {r[0]: [] for r in rows}
    for r in damaged(rows):
        conversations[r[0]].append(r)
    out = []
    for conv, own in conversations.items():
        own.sort(key=order)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = faults(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, left = cheapest([(r[2], r[3], k in ("blank", "duplicate"), k == "cut") for r, k in zip(own, kinds)])
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("cut"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def made(seed, lengths):
    rng, rows = random.Random(seed), []
    for conv, n in lengths.items():
        odd = rng.random()
        for k in range(n):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "umpire"] if rng.random() < odd else ["user", "assistant"])
            text = rng.choice([None, "", " ", "a.", "b!", "same.", f"x{k}.", f"y{k}", f"z{k}?  "] if conv != 2 else [f"q{k}"])
            rows.append((conv, rng.choice([None, k, k, k // 2, 10 * k]), role, text))
    return rows


def report(df):
    return sorted((tuple(r) for r in repair_report(df, in_order(damage(df))).collect()), key=str)


def test_cheapest_by_trying_everything():
    """The plain version and the grammar, on all audits of very short conversations."""
    rng = random.Random(7)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), str(k), rng.random() < 0.2, rng.random() < 0.3) for k in range(rng.randint(0, 3))]
        found = []
        gaps = [g for n in range(3) for g in product("ua", repeat=n)]
        for before in product(gaps, repeat=len(rows) + 1):
            for edits in product(["D", "K", "Ru", "Ra"], repeat=len(rows)):
                cost, audit, roles = 5 * sum(map(len, before)), "", []
                for (role, _, must, cut), edit, new in zip(rows, edits, before):
                    if must and edit != "D":
                        cost = None
                        break
                    roles += new
                    audit += "I" * len(new) + edit[0]
                    cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + (5 if cut and edit != "D" else 0)
                    roles += [] if edit == "D" else [role[0] if edit == "K" else edit[1]]
                if cost is not None and re.fullmatch("(s?(ua)+)?", "".join(roles + list(before[-1]))):
                    found.append((cost, audit + "I" * len(before[-1])))
        assert cheapest(rows)[:2] == min(found)


def test_query_over_the_whole_table(spark):
    found = sorted((tuple(r) for r in QUERIES["op12_conversation_repair"](spark, FOLDER).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found == plain(rows) and len(found) > 10


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_long_conversations_in_many_chunks(spark, monkeypatch, seed):
    """Chunks of four rows, over five parts; one conversation without an id."""
    monkeypatch.setattr(conversation_repair, "CHUNK_BITS", 2)
    rows = made(seed, {None: 120, 1: 300, 2: 90, 3: 1, 4: 0, 5: 33})
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert report(df) == plain(rows)


def test_one_conversation_of_copies(spark, monkeypatch):
    """Copies must go and take no part in the passes, however many parts they fill."""
    monkeypatch.setattr(conversation_repair, "CHUNK_BITS", 2)
    passes = []
    over = conversation_repair._Pass.over
    monkeypatch.setattr(conversation_repair._Pass, "over", lambda self, df: passes.append(self.towards) or over(self, df))
    rows = [(1, 0, "user", "Hello.")] + [(1, 7, "assistant", "Same.")] * 200 + [(1, 9, "user", "no end"), (1, 10, "user", "End.")]
    assert report(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)
    assert len(passes) <= 4


def test_parts_without_convergence(spark, monkeypatch):
    """Cut rows keep differences alive; the vector still gets through all parts."""
    monkeypatch.setattr(conversation_repair, "CHUNK_BITS", 2)
    rows = [(1, k, ["user", "assistant"][k % 3 == 0], f"t{k}") for k in range(150)] + [(1, 200, "assistant", "A."), (1, 201, "user", "b")]
    assert report(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


def test_vectors_converge():
    """From whatever vector a chunk starts, some ordinary rows lead to the same one."""
    grammar = Grammar()
    codes = bytes([2, 3] * 8)
    assert len({grammar.first_vector(codes, grammar.number(v)) for v in ((0, 10, 5, 0), (0, 0, 0, 0), (3, 1, 0, 5))}) == 1
    old = grammar.first_vector(codes, grammar.terminal)
    for end in ((0, 0, 0, 0), (0, 5, 5, 0)):
        number = grammar.number(end)
        assert grammar.again(codes, grammar.terminal, old, number) == grammar.first_vector(codes, number)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (2, 0, "assistant", "x."), (3, 5, "system", " ")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit(1)).withColumn("Step", F.lit("x"))
    found = [tuple(r)[0:1] + tuple(r)[3:] for r in repair(df).orderBy("conv_id", "pos", "step").collect()]
    assert found == [(1, 1, "user", "B."), (1, 2, "assistant", "C.")]
    shown = {(r["conv_id"], r["inserted"], r["edit"]) for r in least_edits(in_order(df.select("conv_id", "turn", "role", "text"))).collect()}
    assert {(1, "", "D"), (1, "", "K"), (2, "", "D"), (3, "", "D")} <= shown


def test_inserted_rows_come_out(spark, monkeypatch):
    """Rows that must be paired at the end: deleting is dearer than inserting."""
    monkeypatch.setattr(conversation_repair, "DELETE", 9)
    df = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "assistant", "B."), (1, 2, "user", "C.")], SCHEMA)
    found = [tuple(r)[3:] for r in repair(df).orderBy("conv_id", "pos", "step").collect()]
    assert found == [(0, "user", "A."), (1, "assistant", "B."), (2, "user", "C."), (None, "assistant", "")]


def test_empty_table_and_conversations_that_vanish(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert report(empty) == [] and repair(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert report(spark.createDataFrame([(gone, 1, "user", "x.")], SCHEMA)) == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "w " * 500_000 + "."), (1, 1, "assistant", "v" * 1_000_000), (None, None, None, None)]
    assert report(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
