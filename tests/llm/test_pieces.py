"""SentencePiece ids against the library, spans against its own record of them."""

from __future__ import annotations

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidelog.llm.piece_codec import Normalizer, PieceCodec, decode_pieces, encode_pieces
from tidelog.llm.queries import QUERIES, piece_model_path

FOLDER = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "  a", "a  ", "▁x", " ▁ ▁", "☃é\n\t z", "\0a", "  \n  ", "<s>", "<0x0A>", "</s> <unk>", "x" * 5000,
    "\U0001F600" * 3 + " b", "é ß 中文 字", " " * 300, "word " * 20_000, "a\r\nb",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def spans(proto):
    return [(p.begin, p.end) for p in proto.pieces]


def test_hard_texts_have_the_library_s_ids_and_spans(model):
    found = list(PieceCodec(piece_model_path()).encode(HARD))
    for text, (ids, begins, ends) in zip(HARD, found):
        assert ids.tolist() == model.encode(text or ""), text
        if text:
            assert list(zip(begins.tolist(), ends.tolist())) == spans(model.encode(text, return_type="proto")), text


def test_every_document_has_the_library_s_ids_spans_and_text(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    coded = decode_pieces(encode_pieces(docs, piece_model_path()), piece_model_path())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["ids"] == model.encode(text) and r["decoded"] == model.decode(r["ids"])
        assert not text or list(zip(r["begins"], r["ends"])) == spans(model.encode(text, return_type="proto"))


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_normalisation_follows_the_compiled_map(rule):
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    normalizer = Normalizer(own.serialized_normalizer_spec())
    rng = random.Random(3)
    pool = " a\tΩ\n　Ａ①㍿ｶﾞéﬁǄß中​\U0001F600 xé"
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        shown, places = own.normalize(text, with_offsets=True)
        data, at = normalizer.of(text.encode())
        starts = [0]
        for char in data.decode():
            starts.append(starts[-1] + len(char.encode()))
        assert data.decode() == shown, text
        assert [len(text.encode()[: at[s]].decode()) for s in starts] == list(places), text


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, frame, corpus):
    path = piece_model_path()
    docs = frame(corpus).withColumn("ids", F.lit(1)).withColumn("Decoded", F.lit(2))
    coded = decode_pieces(encode_pieces(docs, path), path)
    assert coded.columns == ["doc_id", "ids", "begins", "ends", "decoded"]
    rows = coded.collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in rows) == sorted((str(r[0]), r[1] or "") for r in corpus)
    assert encode_pieces(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        decode_pieces(docs, path)
    some = spark.createDataFrame([(1, [0xC3 + 3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r[0]: r[2] for r in decode_pieces(some, path).collect()} == {1: "�", 2: None, 3: ""}


def test_query(spark, model):
    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op11_piece_codec"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r["doc_id"]])
        assert tuple(r)[1:] == (
            len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids)), len(texts[r["doc_id"]].encode())
        )
