"""Quality rules and line de-duplication against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import doc
from tidelog.llm.line_dedup import PerfectHash, dedup_lines
from tidelog.llm.line_rules import apply_line_rules, line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\f\r"


def lower(text):
    return text.encode().lower().decode()


# --- quality rules ---------------------------------------------------------------------

def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def removed(rows, min_docs=10, max_percent=2):
    """Lines that go, by row."""
    norm = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x)).strip(" ").lower()
    lines = [[(k, norm(x)) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t, _, _, _ in rows]
    holders, hosts = defaultdict(set), defaultdict(set)
    first = {}
    for (i, t, _, host, _), own in zip(rows, lines):
        hosts[host].add(t or "")
        for _, x in own:
            holders[host, x].add(t or "")
            if i is not None:
                first[host, x] = min(first.get((host, x), i), i)
    above = {k for k, v in holders.items() if len(v) >= min_docs and 100 * len(v) >= max_percent * len(hosts[k[0]])}
    return [
        [(k, len(x.split(" "))) for k, x in own if (host, x) in above and first.get((host, x)) != i]
        for (i, _, _, host, _), own in zip(rows, lines)
    ]


@pytest.mark.parametrize("limits", [{}, {"min_docs": 3, "max_percent": 1}])
def test_rules_match_plain_python(frame, corpus, limits):
    rows = [r for r in corpus]
    found = Counter(map(tuple, line_rules(frame(rows), **limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_gone").collect()))
    expected = Counter()
    for r, gone in zip(rows, removed(rows, **limits)):
        b = base(r[1])
        expected[(r[0], *b, not b[-1] and b[0] - sum(w for _, w in gone) >= 20, len(gone))] += 1
    assert found == expected
    assert any(k[-1] for k in expected) == bool(limits) or limits == {}


def test_rules_applied_to_texts(frame, corpus):
    limits = {"min_docs": 3, "max_percent": 1}
    docs = frame(corpus)
    found = Counter((r["doc_id"], r["text"], r["source"]) for r in apply_line_rules(docs, **limits).collect())
    expected = Counter()
    for r, gone in zip(corpus, removed(corpus, **limits)):
        b, places = base(r[1]), {k for k, _ in gone}
        text = r[1] if not places else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in places)
        if not b[-1] and len(WORD.findall(text or "")) >= 20:
            expected[(r[0], text, r[3])] += 1
    assert found == expected
    assert apply_line_rules(docs).columns == docs.columns


def test_copies_of_a_document_deplete_none(frame):
    text = "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(9)) for i in range(6))
    rows = [doc(i, text) for i in range(40)]
    assert line_rules(frame(rows)).where("kept").count() == 40


def test_rules_with_clashing_columns_and_no_rows(spark, frame):
    clash = frame([doc(1, "a b c " * 10)]).selectExpr("*", "1 AS host", "2 AS content", "3 AS place", "4 AS line", "'x' AS row")
    assert line_rules(clash).count() == 1
    assert apply_line_rules(clash).columns == clash.columns
    assert line_rules(clash.limit(0)).count() == 0


# --- line de-duplication ---------------------------------------------------------------------

def plain_dedup(rows, min_chars=40, min_docs=5):
    keys = [[lower(x.strip(WHITE)) for x in (t or "").split("\n")] for _, t, *_ in rows]
    n, owner = Counter(), {}
    low = -(1 << 63)
    for (i, *_), own in zip(rows, keys):
        for key in set(own):
            n[key] += 1
            owner[key] = max(owner.get(key, low), low if i is None else i)
    found = Counter()
    for (i, t, *_), own in zip(rows, keys):
        here = low if i is None else i
        gone = [len(k) >= min_chars and n[k] >= min_docs and owner[k] != here for k in own]
        left = "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)
        found[(i, len(own), sum(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    return found


@pytest.mark.parametrize("path", [{}, {"broadcast_bytes": 0, "shard_keys": 5}, {"shard_keys": 3}])
def test_line_dedup_matches_plain_python(frame, corpus, path):
    found = dedup_lines(frame(corpus), min_docs=3, statistics=True, **path).collect()
    digest = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in found)
    assert digest == plain_dedup(corpus, min_docs=3)
    assert any(k[2] for k in digest)


def test_line_dedup_keeps_columns(frame, corpus):
    clash = frame(corpus).selectExpr("*", "1 AS shard", "2 AS g_doc", "3 AS h", "'x' AS n_lines")
    for limit in (64 << 20, 0):
        done = dedup_lines(clash, min_docs=3, broadcast_bytes=limit)
        assert done.columns == clash.columns and done.count() == len(corpus)
        assert done.where("text IS NULL").count() == sum(r[1] is None for r in corpus)
        assert done.where("n_chars <> length(text)").count() == 0
    assert dedup_lines(clash.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 62, 50_000).astype(np.uint64))
    index = PerfectHash.build(keys)
    assert sorted(index.numbers(keys)) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).numbers(keys[:5]).tolist() == [-1] * 5
