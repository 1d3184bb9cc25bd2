"""Conversations repaired at least cost, by a parallel Viterbi with rank convergence.

The rows of a conversation lie in chunks, and its chunks in one or more parts. The costs
to the end start in every part from a speculative vector, one cost per state of the
grammar of roles; only differences within a vector matter, as a constant never changes a
choice. Fix-up passes hand a part the vector its successor came to and run its chunks
again until the old and the new vector differ by a constant only; from there on nothing
changes. The stitched costs then lead the tracing of the least audit, which runs over the
same chunks in the other direction and is fixed up in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm.common import SPACE, saved

# What an edit costs, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# Kinds of damage by remainder.
DAMAGE_KINDS = 20

# Rows of a chunk, and chunks of a part, as powers of two.
CHUNK_BITS, PART_BITS = 12, 33

# Rows that a task gathers before it hands them on.
_RESULTS = 1 << 14

# States of the grammar ``(s?(ua)+)?``: nothing yet, after the system row, after a user
# row, after an assistant row. A conversation may end in the first and in the last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
# Costs to the end where nothing is left: 'ua' after the system row, 'a' after a user row.
_TERMINAL = (0, 2 * INSERT, INSERT, 0)

# Bits of a row's code: the role's initial, truncated, must go, first of its kind.
_OTHER, _S, _U, _A = range(4)
_CUT, _FORCED, _FIRST = 4, 8, 16

# Kinds of records while rows and edits are brought together.
_MARKER, _ROW, _EDIT, _TAIL = range(4)
_BEYOND = 2**63 - 1


# --- the grammar ------------------------------------------------------------------------

class Grammar:
    """Costs to the end as vectors without their constant, numbered as they turn up.
    There are few, so that every step is computed once and then looked up."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self.picks: dict[tuple[int, int, int], tuple[str, str, int]] = {}
        self.terminal = self.number(_TERMINAL)

    def number(self, costs: tuple[int, ...]) -> int:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    @staticmethod
    def _moves(code: int, state: int) -> Iterator[tuple[str, int, int]]:
        """Edits of a row other than deletion: initial, cost and state after it."""
        role, cut = code & 3, TRUNCATED if code & _CUT else 0
        if role == _S and state == _START:
            yield "K", cut, _SYSTEM
        if (role == _U and state != _USER) or (role == _A and state == _USER):
            yield "K", cut, _AFTER[state]
        yield "R", REROLE + cut, _AFTER[state]

    def _costs(self, vector: int, code: int) -> list[int]:
        """Costs to the end before a row, given those after it."""
        after = self.vectors[vector]
        own = [min(DELETE + after[s], *(c + after[to] for _, c, to in self._moves(code, s))) for s in range(4)]
        # an insertion before the row, or two
        for _ in range(2):
            own = [min(own[s], INSERT + own[_AFTER[s]]) for s in range(4)]
        return own

    def back(self, vector: int, code: int) -> int:
        key = vector, code
        if key not in self.steps:
            self.steps[key] = self.number(tuple(self._costs(vector, code)))
        return self.steps[key]

    def pick(self, vector: int, code: int, state: int) -> tuple[str, str, int]:
        """The least of the cheapest ways past a row: roles inserted before it, the edit,
        the state after it. ``vector`` holds the costs after the row."""
        key = vector, code, state
        if key not in self.picks:
            after, before = self.vectors[vector], self._costs(vector, code)
            inserted = ""
            while DELETE + after[state] != before[state]:
                to = _AFTER[state]
                if INSERT + before[to] == before[state]:
                    inserted += _ROLE[to][0]
                    state = to
                    continue
                edit, to = next((e, to) for e, c, to in self._moves(code, state) if c + after[to] == before[state])
                self.picks[key] = inserted, edit, to
                break
            else:
                self.picks[key] = inserted, "D", state
        return self.picks[key]

    @staticmethod
    def tail(state: int) -> str:
        """Roles inserted at the end."""
        return {_START: "", _SYSTEM: "ua", _USER: "a", _ASSISTANT: ""}[state]

    # a chunk: the codes of its rows

    def vectors_of(self, codes: bytes, end: int) -> list[int]:
        """For each row the vector after it."""
        found, vector = [0] * len(codes), end
        for at in range(len(codes) - 1, -1, -1):
            found[at] = vector
            vector = self.back(vector, codes[at])
        return found

    def first_vector(self, codes: bytes, end: int) -> int:
        for code in reversed(codes):
            end = self.back(end, code)
        return end

    def again(self, codes: bytes, old_end: int, old_first: int, end: int) -> int:
        """The first vector from another end: both run until they meet."""
        for code in reversed(codes):
            if old_end == end:
                return old_first
            old_end, end = self.back(old_end, code), self.back(end, code)
        return end

    def last_state(self, codes: bytes, end: int, state: int) -> int:
        for code, vector in zip(codes, self.vectors_of(codes, end)):
            state = self.pick(vector, code, state)[2]
        return state


def _shown(vector: tuple[int, ...]) -> str:
    return ",".join(map(str, vector))


def _read(grammar: Grammar, vector: str) -> int:
    return grammar.number(tuple(map(int, vector.split(","))))


# --- rows in order -------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults: by the remainder of a row's hash it is
    dropped (0), emptied (1), loses its sentence ends (2), comes twice (3) or gets the
    role user (4). NULL roles and texts are one space, and so is NULL in the hashed key."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(key), F.lit(DAMAGE_KINDS))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("_kind")
    ).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("col")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows numbered: ``pos`` rises by conversation, turn (NULL first), role and text.
    Rows are dealt by ranges of these, so that a long conversation lies in many parts;
    the part a row was read in tells copies of one row apart for that."""
    start = lambda c: F.substring(c, 1, 32)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), start("role"), start("text")]
    ranged = rows.withColumn("_part", F.spark_partition_id()).repartitionByRange(*keys, F.col("_part"))
    ordered = ranged.sortWithinPartitions(*keys, "role", "text").drop("_part")
    return saved(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, code``. The first row of its kind is found by the least number per
    role and text, and meets its own code by number, so that no row is joined by a
    frequent role and text."""
    solid = "[^\\x20\\x09-\\x0D]"
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", _S).when(initial == "u", _U).when(initial == "a", _A).otherwise(_OTHER)
    blank = ~F.col("text").rlike(solid)
    cut = ~F.col("text").rlike(f"[.!?]{SPACE}*\\z")
    code = role + F.when(blank, _FORCED).otherwise(0) + F.when(cut, _CUT).otherwise(0)
    coded = rows.select("conv_id", "pos", code.cast("int").alias("code"), "role", F.sha2("text", 256).alias("text"))
    first = coded.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("pos"))
    records = coded.select("conv_id", "pos", "code").unionAll(first.select("conv_id", "pos", F.lit(_FIRST).alias("code")))
    met = records.groupBy("pos").agg(F.max("conv_id").alias("conv_id"), F.bit_or("code").alias("code"))
    forced = F.col("code").bitwiseAND(_FIRST) == 0
    return met.select("conv_id", "pos", F.when(forced, F.col("code").bitwiseOR(_FORCED)).otherwise(F.col("code")).alias("code"))


def _chunks(faults: DataFrame) -> DataFrame:
    """``conv_id, part, chunk, codes, places``: the rows that may stay, in order, at most
    ``2 ** CHUNK_BITS`` of a conversation in a chunk. Rows that must go change no cost;
    were they in the chunks, vectors would pass through a long run of copies unchanged."""
    live = faults.where(F.col("code").bitwiseAND(_FORCED) == 0).repartitionByRange("pos").sortWithinPartitions("pos")
    most = 1 << CHUNK_BITS
    names = ["conv_id", "part", "chunk", "codes", "places"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        codes, places, own, number = bytearray(), [], None, 0
        for batch in batches:
            for conv_id, pos, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "code"))):
                if codes and (conv_id != own or len(codes) == most):
                    done.append((own, part, part << PART_BITS | number, bytes(codes), places))
                    codes, places, number = bytearray(), [], number + 1
                own = conv_id
                codes.append(code)
                places.append(pos)
            if sum(len(row[3]) for row in done) >= _RESULTS:
                yield _batch(done, names, types)
        if codes:
            done.append((own, part, part << PART_BITS | number, bytes(codes), places))
        if done:
            yield _batch(done, names, types)

    return live.mapInArrow(gather, "conv_id long, part long, chunk long, codes binary, places array<long>")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """The gathered rows, of which none are left."""
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    rows.clear()
    return pa.RecordBatch.from_arrays(columns, names=names)


def _linked(chunks: DataFrame) -> DataFrame:
    """Adds the chunks of the same conversation before and after, NULL where there is
    none. Chunks are numbered through within a part; the first one of a part follows the
    last one of the part before it that has rows. There are as many parts as the session
    has shuffle partitions, at most."""
    order = Window.orderBy("part")
    parts = chunks.groupBy("part").agg(F.max("chunk").alias("last")).select(
        "part", "last",
        F.shiftleft(F.lead("part").over(order), PART_BITS).alias("following"),
        F.lag("last").over(order).alias("leading"),
    )
    after = F.when(F.col("chunk") < F.col("last"), F.col("chunk") + 1).otherwise(F.col("following"))
    before = F.when(F.col("chunk") > F.shiftleft("part", PART_BITS), F.col("chunk") - 1).otherwise(F.col("leading"))
    placed = chunks.join(F.broadcast(parts), "part").withColumns({"after": after, "before": before})
    placed = placed.drop("last", "following", "leading")
    there = chunks.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"))
    for side in ("after", "before"):
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(side) == F.col("_chunk"))
        placed = placed.join(there, same, "left").withColumn(side, F.col("_chunk")).drop("_conv", "_chunk")
    return placed


# --- passes over the chunks --------------------------------------------------------------

class _Pass(NamedTuple):
    """Chunks run in order, each from what its neighbour ``towards`` has come to. At the
    end of a part that is what the part beyond has told, or a guess."""

    towards: str
    given: str
    got: str
    guess: Callable[[dict], str]
    run: Callable[[Grammar, dict, str], str]
    again: Callable[[Grammar, dict, str], str]

    def over(self, chunks: DataFrame) -> DataFrame:
        order = F.col("chunk").desc() if self.towards == "after" else F.col("chunk")
        columns = [c for c in chunks.columns if c not in (self.given, self.got, "_told")]
        known = self.got in chunks.columns
        dealt = chunks.repartition("part").sortWithinPartitions("part", order)
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*columns).schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grammar, last = Grammar(), (None, "")
            for batch in batches:
                given, got = [], []
                for row in batch.to_pylist():
                    told = row["_told"] if known else self.guess(row)
                    if row[self.towards] is not None and row[self.towards] == last[0]:
                        told = last[1]
                    value = self.again(grammar, row, told) if known else self.run(grammar, row, told)
                    last = row["chunk"], value
                    given.append(told)
                    got.append(value)
                made = [pa.array(given, pa.string()), pa.array(got, pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=[*columns, self.given, self.got])

        return dealt.mapInArrow(run, f"{kept}, {self.given} string, {self.got} string")

    def until_stitched(self, chunks: DataFrame) -> DataFrame:
        """Passes until every chunk has run from what its neighbour has come to."""
        chunks = saved(self.over(chunks), "pass")
        while True:
            told = chunks.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), F.col(self.got).alias("_told"))
            same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(self.towards) == F.col("_chunk"))
            heard = chunks.join(told, same, "left").drop("_conv", "_chunk").withColumn("_told", F.coalesce("_told", self.given))
            if heard.where(F.col("_told") != F.col(self.given)).isEmpty():
                return chunks
            chunks = saved(self.over(heard), "pass")


def _first_vector(grammar: Grammar, row: dict, end: str) -> str:
    return _shown(grammar.vectors[grammar.first_vector(row["codes"], _read(grammar, end))])


def _first_vector_again(grammar: Grammar, row: dict, end: str) -> str:
    if end == row["end"]:
        return row["begin"]
    old, begin, new = (_read(grammar, v) for v in (row["end"], row["begin"], end))
    return _shown(grammar.vectors[grammar.again(row["codes"], old, begin, new)])


def _last_state(grammar: Grammar, row: dict, entered: str) -> str:
    return str(grammar.last_state(row["codes"], _read(grammar, row["end"]), int(entered)))


def _last_state_again(grammar: Grammar, row: dict, entered: str) -> str:
    return row["left"] if entered == row["entered"] else _last_state(grammar, row, entered)


def _costs() -> _Pass:
    return _Pass("after", "end", "begin", lambda row: _shown(_TERMINAL), _first_vector, _first_vector_again)


def _states() -> _Pass:
    guess = lambda row: str(_START if row["before"] is None else _ASSISTANT)
    return _Pass("before", "entered", "left", guess, _last_state, _last_state_again)


def least_edits(rows: DataFrame) -> DataFrame:
    """The edits of numbered rows (see ``in_order``): one per row, ``conv_id, pos, kind,
    code, inserted, edit, role``, with the roles inserted before it and the role it gets
    if that changes; and one of kind ``_TAIL``, its ``pos`` beyond all rows, for what is
    inserted after the last one.

    The cheapest edits, of equally cheap ones those whose initials come first. Chunks of
    at most ``2 ** CHUNK_BITS`` rows bound what a task holds, however long a conversation
    is. Costs converge within some rows as a rule, so that one pass and one fix-up do; the
    number of parts that a conversation lies in is the bound.
    """
    faults = saved(_faults(rows), "faults")
    costs = _costs().until_stitched(_linked(saved(_chunks(faults), "chunks")))
    states = _states().until_stitched(costs.drop("begin"))
    names = ["conv_id", "pos", "kind", "code", "inserted", "edit", "role"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                codes, state, conv_id = row["codes"], int(row["entered"]), row["conv_id"]
                for pos, code, vector in zip(row["places"], codes, grammar.vectors_of(codes, _read(grammar, row["end"]))):
                    before, edit, state = grammar.pick(vector, code, state)
                    found.append((conv_id, pos, _EDIT, code, before, edit, _ROLE[state] if edit == "R" else None))
                if row["after"] is None:
                    found.append((conv_id, _BEYOND, _TAIL, None, grammar.tail(state), "", None))
                if len(found) >= _RESULTS:
                    yield _batch(found, names, types)
            if found:
                yield _batch(found, names, types)

    traced = states.mapInArrow(trace, "conv_id long, pos long, kind int, code int, inserted string, edit string, role string")
    forced = faults.where(F.col("code").bitwiseAND(_FORCED) != 0).select(
        "conv_id", "pos", F.lit(_EDIT).alias("kind"), "code", F.lit("").alias("inserted"), F.lit("D").alias("edit"),
        F.lit(None).cast("string").alias("role"))
    return traced.unionAll(forced)


# --- results --------------------------------------------------------------------------------

def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows of ``rows`` (``conv_id, turn, role, text``): ``conv_id, pos, step,
    turn, role, text``, in the order of ``pos`` and ``step``. Inserted rows have no turn
    and an empty text.

    Rows are blank without a character other than ASCII white space, duplicates when the
    conversation has their role and text before, truncated when their last such character
    is none of ``.!?``; the first of these counts. Equal turns are ordered by role and
    text. NULL roles and texts are one space; NULL turns come first; rows with a NULL
    conv_id are one conversation; an empty table gives an empty result; extra columns are
    left out. Very long texts are only hashed and passed on.
    """
    blank = F.lit(" ")
    plain = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    ordered = in_order(plain)
    edits = least_edits(ordered).withColumnsRenamed({"conv_id": "_conv", "pos": "_pos", "role": "_role"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos"))
    both = edits.join(ordered, same, "left")
    full = lambda c: F.when(c == "u", _ROLE[_USER]).otherwise(_ROLE[_ASSISTANT])
    letters = F.filter(F.split("inserted", ""), lambda c: c != "")
    nothing = F.lit(None).cast("long")
    added = F.transform(letters, lambda c: F.struct(nothing.alias("turn"), full(c).alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("_role", "role").alias("role"), "text"))
    steps = F.when(F.col("edit").isin("K", "R"), F.concat(added, own)).otherwise(added)
    placed = both.select("_conv", "_pos", F.posexplode(steps).alias("step", "row"))
    return placed.select(F.col("_conv").alias("conv_id"), F.col("_pos").alias("pos"), "step", "row.turn", "row.role", "row.text")


class _Digest:
    """What a conversation's rows and edits add up to, fed in order and kept small but for
    the audit, which has a letter per edit."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.low = self.high = self.seen = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.last = None
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def row(self, turn: int | None, role: str) -> None:
        if turn is not None and turn != self.seen:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.seen = turn
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]

    def edit(self, edit: str, inserted: str, code: int | None, role: str | None, row: tuple[str, str] | None) -> None:
        for initial in inserted:
            self.line(_ROLE[_USER if initial == "u" else _ASSISTANT], "")
        self.audit.append("I" * len(inserted) + edit)
        self.cost += INSERT * len(inserted) + {"D": DELETE, "R": REROLE}.get(edit, 0)
        if edit in ("K", "R"):
            self.cost += TRUNCATED if code & _CUT else 0
            self.line(role or row[0], row[1])

    def fault(self, code: int, text: str) -> None:
        if code & _FORCED:
            if text.strip(" \t\n\x0b\f\r"):
                self.duplicate += 1
            else:
                self.blank += 1
        elif code & _CUT:
            self.truncated += 1

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
            "".join(self.audit), self.hash.hexdigest(),
        )


DIGEST_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def repair_report(conversations: DataFrame, ordered: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost and the initials of its edits, and a hash of
    the repaired conversation. Conversations of ``conversations`` that have no row in
    ``ordered`` (see ``in_order``) have zeros, an empty audit and the hash of nothing.

    The hash of a conversation is one chain, so its rows pass through one task; they
    stream, and only the hash, some counts and the audit are held.
    """
    none = {"turn": "long", "role": "string", "text": "string", "code": "int", "inserted": "string", "edit": "string"}
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in none.items()}
    marks = conversations.select("conv_id").distinct().select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("pos"), F.lit(_MARKER).alias("kind"), *empty.values())
    rows = ordered.select(
        "conv_id", "pos", F.lit(_ROW).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text",
        empty["code"], empty["inserted"], empty["edit"])
    edits = least_edits(ordered).select("conv_id", "pos", "kind", empty["turn"], "role", empty["text"], "code", "inserted", "edit")
    records = marks.unionAll(rows).unionAll(edits).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, done = None, None, []
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "code", "inserted", "edit")]
            for conv_id, kind, turn, role, text, code, inserted, edit in zip(*values):
                if kind == _MARKER:
                    if own:
                        done.append(own.result())
                    own = _Digest(conv_id)
                elif kind == _ROW:
                    own.row(turn, role)
                    row = role, text
                else:
                    if code is not None:
                        own.fault(code, row[1])
                    own.edit(edit, inserted, code, role, row)
            if len(done) >= _RESULTS:
                yield _batch(done, names, types)
        if own:
            done.append(own.result())
        if done:
            yield _batch(done, names, types)

    return records.mapInArrow(digest, DIGEST_SCHEMA)
