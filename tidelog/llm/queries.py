"""The registered queries of the pipeline operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm.common import table
from tidelog.llm.conversation_repair import damage, in_order, repair_report
from tidelog.llm.line_dedup import dedup_lines
from tidelog.llm.line_rules import line_rules
from tidelog.llm.mixing import mix
from tidelog.llm.near_dups import near_duplicates
from tidelog.llm.packing import pack
from tidelog.llm.piece_codec import decode_pieces, encode_pieces
from tidelog.llm.pii import find_pii
from tidelog.llm.quality import classify
from tidelog.llm.rnn_lm import score_texts
from tidelog.llm.substring import dedup_spans
from tidelog.llm.topk import top_k
from tidelog.llm.whitening import by_component, whiten

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


# --- 6, quality rules -------------------------------------------------------------------

_RULES_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
s AS (SELECT doc_id, source, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
p AS (SELECT doc_id, i, words[i:i + 7] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, source, text, line,
              lower(trim(regexp_replace(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS norm
       FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
f AS (SELECT source, norm, count(DISTINCT text) AS n, min(doc_id) AS first_doc FROM lw GROUP BY source, norm HAVING count(DISTINCT text) >= 10),
h AS (SELECT source, count(DISTINCT text) AS n_host FROM d GROUP BY source),
g AS (SELECT f.* FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE 100 * f.n >= 2 * h.n_host),
lost AS (SELECT lw.doc_id, count(*) AS n_lines_gone, sum(len(string_split(lw.norm, ' '))) AS n_words_gone
         FROM lw JOIN g ON lw.source IS NOT DISTINCT FROM g.source AND lw.norm = g.norm WHERE lw.doc_id <> g.first_doc GROUP BY lw.doc_id),
b AS (SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
             coalesce(c.n_repeat_words, 0) AS n_repeat_words,
             coalesce(lost.n_words_gone, 0)::BIGINT AS n_words_gone, coalesce(lost.n_lines_gone, 0) AS n_lines_gone
      FROM s LEFT JOIN c USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_words_gone >= 20 AS kept FROM v
"""


@_register("op6_quality_rules", _RULES_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of cross-document line frequency, per document."""
    return line_rules(table(spark, sf_dir, "documents"))


# --- 7, line de-duplication --------------------------------------------------------------

_LINES_SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM s),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.place, f.key IS NOT NULL AND f.owner <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@_register("op7_line_dedup", _LINES_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per document, how many go, and a digest of what is left."""
    rows = dedup_lines(table(spark, sf_dir, "documents"), statistics=True)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# --- 5, packing ----------------------------------------------------------------------------

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_register("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


# --- 10, mixing ------------------------------------------------------------------------------

_TIME = {
    # the inverse of the integrated schedule for each weight; part runs from 0 to 1
    5: "CASE WHEN part >= 0.5625e0 THEN 0.5e0 + 2e0 * greatest(part - 0.5625e0, 0e0) / (1e0 + sqrt(greatest(1e0 - 1e0 * greatest(part - 0.5625e0, 0e0), 0e0))) "
       "ELSE 2e0 * part / (1.25e0 + sqrt(greatest(1.5625e0 - 1e0 * part, 0e0))) END",
    2: "2e0 * part / (1e0 + sqrt(1e0))",
    1: "CASE WHEN part >= 0.375e0 THEN 0.5e0 + 2e0 * greatest(part - 0.375e0, 0e0) / (1e0 + sqrt(greatest(1e0 + 2e0 * greatest(part - 0.375e0, 0e0), 0e0))) "
       "ELSE 2e0 * part / (0.5e0 + sqrt(greatest(0.25e0 + 2e0 * part, 0e0))) END",
}
_MIX_SQL = f"""
WITH z AS (SELECT doc_id, source, coalesce(len({_WORDS}), 0) AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight, 2e0 * source_size AS bound FROM t),
r AS (SELECT *, (1.5e0 * (SELECT sum(source_size)::DOUBLE FROM t)
                 - coalesce(sum(bound) OVER (ORDER BY bound / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
                / sum(weight) OVER (ORDER BY bound / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT max(level) AS level FROM r WHERE bound >= level * weight),
g AS (SELECT r.source, r.source_size, r.weight,
             CASE WHEN r.bound >= r.level * r.weight THEN f.level * r.weight ELSE r.bound END AS target FROM r, f),
s AS (SELECT z.*, g.source_size, g.weight, g.target,
             coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY md5(doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, greatest(least(floor(target)::BIGINT - start, size), 0) + greatest(least(floor(target)::BIGINT - source_size - start, size), 0) AS taken,
             CASE WHEN target > 0 THEN least(start / target, 1e0) END AS part FROM s)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN least(CASE weight WHEN 5 THEN {_TIME[5]} WHEN 2 THEN {_TIME[2]} ELSE {_TIME[1]} END, 1e0) END AS position
FROM k
"""


@_register("op10_curriculum_mix", _MIX_SQL)
def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, and where in training it stands first."""
    return mix(table(spark, sf_dir, "documents"))


# --- 2, near-duplicates ------------------------------------------------------------------------

@_register("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, over runs of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


# --- 8, exact top-k search -----------------------------------------------------------------------

_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@_register("op8_segment_top_k", _TOP_SQL)
def op8_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0))


# --- 1, substring de-duplication ------------------------------------------------------------------

@_register("op1_sentence_spans")
def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentence spans that an earlier place has."""
    return dedup_spans(table(spark, sf_dir, "documents"))


# --- 3, quality ---------------------------------------------------------------------------------

@_register("op3_rule_quality")
def op3_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, from rules fitted on the labels that are not held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- 4, personal data ---------------------------------------------------------------------------

@_register("op4_weak_supervision_pii")
def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, all spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.col(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


# --- 9, language model --------------------------------------------------------------------------

@_register("op9_gated_rnn_score")
def op9_gated_rnn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under word counts and under the recurrent model."""
    return score_texts(table(spark, sf_dir, "documents"))


# --- 11, SentencePiece ids ------------------------------------------------------------------------

def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_register("op11_piece_codec")
def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they give back, and how many
    of its bytes they cover."""
    model = piece_model_path()
    coded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )


# --- 12, conversations --------------------------------------------------------------------------

@_register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, in_order(damage(conversations)))


# --- 13, whitening --------------------------------------------------------------------------------

@_register("op13_qdwh_whitening")
def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight strongest components, at unit variance."""
    return by_component(whiten(table(spark, sf_dir, "embeddings")))
