"""Fixtures of the operator tests: a session and small tables of hard cases."""

from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents as a DataFrame, dealt over several partitions."""

    def make(rows, schema=DOC_SCHEMA, partitions=3):
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text))


@pytest.fixture(scope="session")
def corpus():
    """Random prose with copies, near copies, shared lines, nulls, empty and long texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def sentence(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."

    shared = [sentence(14) for _ in range(3)]
    passage = " ".join(sentence(13) for _ in range(5))
    rows = []
    for i in range(150):
        lines = [" ".join(sentence(rng.randint(3, 18)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if i % 9 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append(doc(i, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    for i in range(150, 200):
        text = rows[rng.randint(0, 20)][1]
        words = text.split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(doc(i, " ".join(words), rng.choice(["a", "b"])))
    rows += [
        doc(200, None), doc(201, ""), doc(202, " \t\n \n"), doc(203, "one"), doc(204, "ONE two three"),
        doc(205, "x " * 6000), doc(206, "\n".join(sentence(12) for _ in range(400))), doc(207, rows[3][1], None),
        doc(None, "a text without an id"), doc(208, "z" * 5000 + " é😀 ß"), rows[3], rows[3], doc(203, "one"),
    ]
    return rows
