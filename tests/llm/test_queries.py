"""The registered queries and the pipeline, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_oracle import compare, duck_views
from tests.llm.test_lines import base, plain_dedup, removed
from tests.llm.test_near_dups import plain_components
from tests.llm.test_packing import plain_targets, words
from tidelog.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_sentences n_removed copied_from text",
    "op2": "doc_id n_shingles component_id kept",
    "op3": "doc_id held_out score predicted",
    "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_words_gone n_lines_gone",
    "op7": "doc_id n_lines n_dropped kept_sha256",
    "op8": "query_id rank vec_id score",
    "op9": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10": "doc_id size source_size target taken position",
    "op11": "doc_id n_tokens ids_sha256 decoded_sha256 n_bytes",
    "op12": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13": "vec_id component n deviation whitened explained identity_error",
}


def test_each_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns == COLUMNS[name.split("_")[0]].split()
    if name in ORACLES:
        assert compare(spark, duck_views(FOLDER), FOLDER, name) == ""
    else:
        key = df.columns[0]
        given = {"doc_id": "documents", "conv_id": "conversations", "vec_id": "embeddings"}[key]
        assert df.select(key).distinct().count() == spark.read.parquet(f"{FOLDER}/{given}.parquet").select(key).distinct().count()


def test_stages_against_plain_python(spark):
    """Every stage on what the one before it kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    results, given = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        found = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(found.collect(), found.schema)
        results[name] = docs
        if name != "pack_sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    expected = Counter()
    for r, gone in zip(given["quality_rules"], removed(given["quality_rules"])):
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in {p for p, _ in gone})
        if not base(r[1])[-1] and words(text) >= 20:
            expected[r[0], text] += 1
    assert Counter((r["doc_id"], r["text"]) for r in results["quality_rules"].collect()) == expected

    digests = plain_dedup(given["line_dedup"])
    assert sum(n for (_, _, dropped, _), n in digests.items() if dropped == 0) <= results["line_dedup"].count()
    before = dict((i, t) for i, t, *_ in given["line_dedup"])
    assert sum(r["text"] != before[r["doc_id"]] for r in results["line_dedup"].collect()) == sum(n for (_, _, dropped, _), n in digests.items() if dropped)

    component = plain_components(given["near_dedup"], 5)
    assert {r["doc_id"] for r in results["near_dedup"].collect()} == {i for i, c in component.items() if i == c}

    sizes = Counter()
    for _, t, _, s, _ in given["mix_sources"]:
        sizes[s] += words(t)
    goal, taken = plain_targets(sizes), Counter()
    longest = Counter()
    for _, t, _, s, _ in given["mix_sources"]:
        longest[s] = max(longest[s], words(t))
    for r in results["mix_sources"].collect():
        taken[r["source"]] += words(r["text"])
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in goal)

    packed = results["pack_sequences"].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, *_ in given["pack_sequences"])


def test_pipeline_runs_as_a_query(spark):
    rows = queries()["pipeline"](spark, FOLDER)
    assert rows.count() > 0 and "sequence_id" in rows.columns
