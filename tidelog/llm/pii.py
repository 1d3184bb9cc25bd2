"""Personal data: patterns, and weakly supervised spans beyond them.

Candidates get the votes of regex, gazetteer, context and shape labelers. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors train a logistic classifier of spans, which decides. Texts never leave column
expressions: only counts of vote and feature patterns, bounded by their number of values,
reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import saved

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The base patterns. They are written so that a run of characters is
# entered once, at its start or where the last match ended, and never backtracked into;
# the matches are those of the plain forms.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for its pattern to be tried.
_NEEDED = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": "[+][0-9]", "secret": "[0-9]"}

# Looser patterns of further candidates.
MORE_PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?{_LABEL}++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?{_LABEL}++)++",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+=*+(?![A-Za-z0-9_/+-])",
}
_MORE_NEEDED = {"email": "[(\\[](?:at|AT)[)\\]]", "phone": "[0-9]{3}[ .-][0-9]{4}", "secret": "[0-9]"}

# Gazetteers.
TOP_DOMAINS = "com org net edu gov io de fr es uk eu info biz co us ca ch at it nl".split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED_IPS = r"^(0|127|255)\."
SECRET_PREFIXES = r"^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|pk_live_|xox[abps]-|ya29|eyJ)"

# Words that speak for or against a kind, looked for in front of a candidate.
CONTEXT = 32
WORDS_FOR = {
    "email": r"(?i)(mail|contact|write to|from|address)",
    "ip": r"(?i)(\bip\b|addr|host|server|client|login)",
    "card": r"(?i)(card|visa|master|amex|credit|payment)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|contact)",
    "secret": r"(?i)(token|key|secret|passw|auth|credential|bearer|api)",
}
WORDS_AGAINST = r"(?i)(version|isbn|doi|page|chapter|order no|checksum|sha-?[0-9]|md5|commit|uuid|build)"

LABELERS = ("regex", "gazetteer", "context", "shape")
FEATURES = ("length", "variety", "digits", "quoted", "told")
# What the span classifier sees.
INPUTS = (*FEATURES, *LABELERS)

_MARK, _OTHER = "\u0001", "\u0002"


# --- spans --------------------------------------------------------------------------------

def matches(text: Column, pattern: str, needed: str) -> Column:
    """Leftmost non-overlapping matches: ``start, end`` in code points (end exclusive) and
    ``value``. ``text`` must not hold the mark, which is put around each match; splitting
    there gives text and matches in turn, whose lengths add up to the places."""
    marked = F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}")
    parts = F.split(marked, _MARK, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("found"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end"), part.alias("value")))
        found = F.when(state["inside"], F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), found.alias("found"))

    return F.when(text.rlike(needed), F.aggregate(parts, begin, step, lambda s: s["found"])).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a card number is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    total = F.aggregate(values, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: str, value: Column) -> Column:
    """The checks a base match must pass."""
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


# --- labelers ---------------------------------------------------------------------------------

def _vote(positive: Column, negative: Column | None = None) -> Column:
    none = F.lit(0)
    return F.when(positive, 1).otherwise(F.when(negative, -1).otherwise(none) if negative is not None else none)


def _variety(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def _votes(kind: str, base: bool, value: Column, before: Column) -> dict[str, Column]:
    """What each labeler says about a candidate: 1, -1, or 0 for no opinion."""
    variety = _variety(value)
    if kind == "email":
        # the last label, among known top domains
        gazetteer = _vote(F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1)).isin(TOP_DOMAINS), value.rlike("[0-9]$"))
        regex, shape = _vote(F.lit(True)), _vote(variety >= 6, variety < 4)
    elif kind == "ip":
        gazetteer = _vote(F.lit(False), value.rlike(RESERVED_IPS))
        regex, shape = _vote(valid("ip", value), ~valid("ip", value)), _vote(value.rlike(r"[0-9]{2,3}\."), F.length(value) < 8)
    elif kind == "card":
        ok = valid("card", value)
        gazetteer, regex, shape = _vote(value.rlike(ISSUERS), ~value.rlike(ISSUERS)), _vote(ok, ~ok), _vote(variety >= 5, variety < 4)
    elif kind == "phone":
        ok = valid("phone", value) if base else value.rlike(r"[2-9][0-9]{2}[) .-]+[2-9]")
        gazetteer = _vote(value.rlike(r"^(\+[1-9]|\(?[2-9][0-9]{2}\)?)"), value.rlike(r"^\+0"))
        regex, shape = _vote(ok, ~ok), _vote(variety >= 5, variety < 4)
    else:
        strict = value.rlike(r"^([A-Z]{4}[0-9A-Z]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[a-z]{2,6}[_-][A-Za-z0-9_-]{16,})$")
        regex = _vote(strict, value.rlike("[/_-].*[/_-].*[/_-]"))
        gazetteer = _vote(value.rlike(SECRET_PREFIXES))
        shape = _vote((variety >= 10) & value.rlike("[0-9].*[A-Za-z].*[0-9].*[A-Za-z]"), ~value.rlike("[0-9].*[A-Za-z].*[0-9]"))
    context = _vote(before.rlike(WORDS_FOR[kind]), before.rlike(WORDS_AGAINST))
    return {"regex": regex, "gazetteer": gazetteer, "context": context, "shape": shape}


def _features(value: Column, before: Column) -> dict[str, Column]:
    """Features of the span classifier, each of few values."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return {
        "length": F.least(F.length(value) / 8, F.lit(6)).cast("int"),
        "variety": F.least(_variety(value) / 3, F.lit(6)).cast("int"),
        "digits": (4 * digits / F.length(value)).cast("int"),
        "quoted": before.rlike("[\"'`]$").cast("int"),
        "told": before.rlike(r"[=:]\s*[\"'`]?$").cast("int"),
    }


def _candidates(kind: str, text: Column, found: Column, base: bool) -> Column:
    def judged(x: Column) -> Column:
        value = x["value"]
        before = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
        votes, features = _votes(kind, base, value, before), _features(value, before)
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            (valid(kind, value) if base else F.lit(False)).alias("base"),
            *[c.cast("int").alias(n) for n, c in (votes | features).items()],
        )

    return F.transform(found, judged)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``, all candidates of its text with votes and features: base
    matches, and looser ones that overlap no valid base match."""
    text = F.col("text")
    rows = docs.select("doc_id", F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(_OTHER)).alias("text"))
    rows = rows.withColumns({f"m_{k}": matches(text, BASE_PATTERNS[k], _NEEDED[k]) for k in BASE_KINDS})
    rows = rows.withColumns({f"x_{k}": matches(text, p, _MORE_NEEDED[k]) for k, p in MORE_PATTERNS.items()})
    rows = rows.withColumn("base", F.concat(*[_candidates(k, text, F.col(f"m_{k}"), True) for k in BASE_KINDS]))
    more = F.concat(*[_candidates(k, text, F.col(f"x_{k}"), False) for k in MORE_PATTERNS])
    apart = F.filter(
        more, lambda x: ~F.exists("base", lambda b: b["base"] & (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )
    return rows.select("doc_id", F.concat("base", apart).alias("found"))


# --- reliabilities and classifier ---------------------------------------------------------------

def reliabilities(counts: Mapping[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Probability that a candidate is personal data, by vote pattern. Labelers are taken
    to err independently; expectation maximisation starts from the mean vote and finds
    how often each says what for true and for false candidates."""
    if not counts:
        return {}
    belief = {v: min(max(0.5 + sum(v) / (2 * len(v)), 0.02), 0.98) for v in counts}
    for _ in range(rounds):
        mass = [1.0 + sum(n * (1 - belief[v]) for v, n in counts.items()), 1.0 + sum(n * belief[v] for v, n in counts.items())]
        said = []
        for k in range(len(LABELERS)):
            # a labeler is believed to be rather right than wrong
            table = [{-1: 4.0, 0: 2.0, 1: 1.0}, {-1: 1.0, 0: 2.0, 1: 4.0}]
            for v, n in counts.items():
                table[0][v[k]] += n * (1 - belief[v])
                table[1][v[k]] += n * belief[v]
            said.append([{x: c / sum(t.values()) for x, c in t.items()} for t in table])
        old = belief
        belief = {}
        for v in counts:
            odds = math.log(mass[1] / mass[0]) + sum(math.log(said[k][1][x] / said[k][0][x]) for k, x in enumerate(v))
            belief[v] = 1 / (1 + math.exp(-max(min(odds, 40.0), -40.0)))
        if max(abs(belief[v] - old[v]) for v in counts) < 1e-6:
            break
    return belief


def train_spans(cells: Iterable[tuple[tuple[int, ...], float, int]], rounds: int = 300, decay: float = 1e-3) -> dict[tuple[str, int], float]:
    """Logistic weights by (feature, value) from cells of ``values of the inputs,
    belief, count``; the entry ("", 0) is the intercept. Gradient steps with a rate per
    weight, on counts scaled to one."""
    rows = [([("", 0), *[(f, x) for f, x in zip(INPUTS, values)]], belief, n) for values, belief, n in cells]
    total = sum(n for *_, n in rows) or 1
    weights = {key: 0.0 for keys, _, _ in rows for key in keys} | {("", 0): 0.0}
    speed = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        slope = {key: decay * w for key, w in weights.items()}
        for keys, belief, n in rows:
            odds = max(min(sum(weights[k] for k in keys), 40.0), -40.0)
            error = (1 / (1 + math.exp(-odds)) - belief) * n / total
            for key in keys:
                slope[key] += error
        for key, s in slope.items():
            speed[key] += s * s
            weights[key] -= 0.5 * s / math.sqrt(speed[key])
    return weights


def _span_odds(weights: Mapping[tuple[str, int], float]) -> Callable[[Column], Column]:
    """The classifier as an expression over a candidate; values never seen add nothing."""

    def odds(x: Column) -> Column:
        total = F.lit(weights[("", 0)])
        for feature in INPUTS:
            own = {v: w for (f, v), w in weights.items() if f == feature}
            part = F.lit(0.0)
            for value, weight in own.items():
                part = F.when(x[feature] == value, F.lit(weight)).otherwise(part)
            total = total + part
        return total

    return odds


def _spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, by kind as listed, then by place."""
    ranked = F.transform(
        spans,
        lambda x: F.struct(
            F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")
        ),
    )
    texts = F.transform(F.sort_array(ranked), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(texts, ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans, n_email, n_ip, n_card, n_phone``: ``base`` and ``spans`` are
    texts of ``kind:start:end`` by kind and place, in code points, end exclusive.

    Base spans are the valid matches of the base patterns and always stay. To them come
    candidates whose labelers' votes, weighed by reliability, and whose own look speak
    for personal data or a secret.

    A NULL text is empty; a text without spans gives empty texts and zeros; a NULL doc_id
    is kept; rows that repeat a document are each searched. An empty table gives an empty
    result; extra columns are left out.
    """
    found = saved(candidates(docs), "spans")
    each = found.select(F.explode("found").alias("x")).select("x.*")
    cells = each.groupBy("kind", "base", *LABELERS, *FEATURES).agg(F.count("*").alias("n")).collect()
    odds: dict[str, Callable[[Column], Column]] = {}
    for kind in KINDS:
        own = [c for c in cells if c["kind"] == kind]
        counts: dict[tuple[int, ...], int] = {}
        for c in own:
            votes = tuple(c[n] for n in LABELERS)
            counts[votes] = counts.get(votes, 0) + c["n"]
        belief = reliabilities(counts)
        odds[kind] = _span_odds(
            train_spans((tuple(c[f] for f in INPUTS), belief[tuple(c[n] for n in LABELERS)], c["n"]) for c in own)
        )

    def accepted(x: Column) -> Column:
        # the votes are among the classifier's inputs: no labeler has a veto
        return x["base"] | reduce(or_, [(x["kind"] == kind) & (odd(x) > 0) for kind, odd in odds.items()])

    base = F.filter("found", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts_ = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in BASE_KINDS}
    return found.select(
        "doc_id",
        _spans_text(base).alias("base"),
        _spans_text(F.filter("found", accepted)).alias("spans"),
        *[c.alias(n) for n, c in counts_.items()],
    )
