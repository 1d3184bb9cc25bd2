"""Quality rules: base statistics of a text and cross-document line frequency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import SPACE, saved, words_of

# Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# A line is above the limits of its host when at least this many distinct documents and
# this share of the host's distinct documents hold it.
MIN_DOCS = 10
MAX_PERCENT = 2

_SALTS = 16


def normal_line(line: Column) -> Column:
    """What makes two lines the same: white space runs and digits do not count, nor does
    letter case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, SPACE + "+", " "), "[0-9]", "0")))


def _paired(hashes: Column, distance: int) -> Column:
    """Hash of each element with the one ``distance`` further on."""
    kept = F.size(hashes) - distance
    return F.zip_with(F.slice(hashes, 1, kept), F.slice(hashes, distance + 1, kept), lambda a, b: F.xxhash64(a, b))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs more than once."""

    def starts(placed: Column) -> Column:
        # a window and its sorted neighbour, where their hashes are the same
        twins = F.zip_with(
            placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

    def words(at: Column) -> Column:
        steps = F.zip_with(
            at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _once(_once(placed, starts), words)


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds the base statistics of ``text`` to documents that carry ``words``."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_words")
    rows = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    rows = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h1": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    # hashes of 2, 4 and 8 words, each from the one before
    rows = rows.withColumn("_h2", F.when(n >= WINDOW, _paired(F.col("_h1"), 1)))
    rows = rows.withColumn("_h4", F.when(n >= WINDOW, _paired(F.col("_h2"), 2)))
    rows = rows.withColumn("_h8", F.when(n >= WINDOW, _paired(F.col("_h4"), 4)))
    # few texts repeat a window; only those are sorted
    repeats = F.size(F.array_distinct("_h8")) < F.size("_h8")
    rows = rows.withColumn("n_repeat_words", F.when(repeats, _covered(F.col("_h8"))).otherwise(F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("_words", "_lines", "_h1", "_h2", "_h4", "_h8")


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a word: the hash of its normal form and its words. Written
    once, as two steps read it."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: normal_line(x))
    # the words of a normal line are its single spaces and one
    entries = F.transform(
        F.filter(lines, lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")),
    )
    rows = docs.select("doc_id", "host", "content", F.posexplode(entries).alias("place", "e"))
    return saved(rows.select("doc_id", "host", "content", "place", "e.line", F.col("e.w").cast("long").alias("w")), "lines")


def frequent_lines(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT) -> DataFrame:
    """``host, line, first_doc``: lines above the limits of their host and the smallest
    doc_id there that holds them. Exact copies count as one document."""
    held = lines.groupBy("host", "line", "content").agg(F.min("doc_id").alias("doc_id"))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    hosts = docs.select("host", "content").distinct().groupBy(F.col("host").alias("h_host")).agg(F.count("*").alias("n_host"))
    limited = counts.where(F.col("n") >= min_docs).join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    return limited.where(100 * F.col("n") >= max_percent * F.col("n_host")).select("host", "line", "first_doc")


def removed_lines(docs: DataFrame, **limits) -> DataFrame:
    """``doc_id, content, host, place, line, w``: the lines that go, once for rows that
    repeat a document. Occurrences of one line are spread over several tasks."""
    lines = line_rows(docs)
    above = frequent_lines(docs, lines, **limits).select(
        F.col("host").alias("f_host"), F.col("line").alias("f_line"), "first_doc",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("f_salt"),
    )
    salt = F.pmod(F.xxhash64("doc_id", "content"), F.lit(_SALTS))
    same = (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")) & (F.col("salt") == F.col("f_salt"))
    gone = lines.withColumn("salt", salt).join(above, same).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return gone.dropDuplicates(["doc_id", "content", "host", "place"]).select("doc_id", "content", "host", "place", "line", "w")


def keyed(docs: DataFrame, host: str) -> DataFrame:
    """``content`` stands for the whole text: exact copies share it."""
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(host).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"),
    )


def _same_document(prefix: str) -> Column:
    return (
        F.col("doc_id").eqNullSafe(F.col(f"{prefix}_doc"))
        & (F.col("content") == F.col(f"{prefix}_content"))
        & F.col("host").eqNullSafe(F.col(f"{prefix}_host"))
    )


def _per_document(gone: DataFrame, prefix: str, *values: Column) -> DataFrame:
    names = [F.col(c).alias(f"{prefix}_{short}") for c, short in (("doc_id", "doc"), ("content", "content"), ("host", "host"))]
    return gone.groupBy(*names).agg(*values)


def line_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """Base statistics and the verdict of each document.

    Lines are normalised and hashed; a line that at least ``min_docs`` distinct
    documents of a host hold, and ``max_percent`` of them, goes from all of them but the
    first. A document that fails a base rule is rejected, and so is one that has fewer
    than ``MIN_WORDS`` words left.

    A NULL text counts as empty, a NULL host as a host of its own. Rows that repeat a
    document get its verdict, each of them. An empty table gives an empty result; extra
    columns are left out.
    """
    rows = keyed(docs, host)
    lost = _per_document(
        removed_lines(rows, **limits), "l", F.sum("w").alias("l_words"), F.count("*").alias("l_lines")
    )
    joined = base_statistics(rows).drop("text").join(lost, _same_document("l"), "left")
    gone = F.coalesce("l_words", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_words") - gone >= MIN_WORDS)).alias("kept"),
        gone.alias("n_words_gone"),
        F.coalesce("l_lines", F.lit(0)).cast("long").alias("n_lines_gone"),
    )


def apply_line_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that are kept, without the lines that go. All columns stay; texts
    without such a line stay as they are, ``n_chars`` follows the text where it exists."""
    rows = keyed(docs, host)
    hashes = _per_document(removed_lines(rows, **limits), "g", F.collect_set("line").alias("g_lines"))
    # only what decides travels beside the rows: their own columns wait in a struct
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = packed.select("row", F.col("row.doc_id").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), F.col(f"row.{host}").alias("host"))
    whole = whole.withColumn("content", F.xxhash64("text")).join(hashes, _same_document("g"), "left")
    left = F.filter(
        F.split("text", "\n", -1), lambda x: ~F.array_contains("g_lines", F.xxhash64(normal_line(x)))
    )
    clean = F.when(F.col("g_lines").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    judged = base_statistics(whole.withColumn("clean", clean))
    kept = ~F.col("base_failed") & (F.col("g_lines").isNull() | (F.size(words_of(F.col("clean"))) >= MIN_WORDS))
    new = F.struct(F.col("clean").alias("text"), F.length("clean").alias("n_chars"))
    # a generator and no filter, which would be pushed below the statistics and compute
    # them over and over
    rows = judged.select("row", F.col("g_lines").isNotNull().alias("changed"), F.explode(F.when(kept, F.array(new))).alias("new"))
    changed = {"text": F.col("new.text")}
    if "n_chars" in docs.columns:
        size = F.when(F.col("changed"), F.col("new.n_chars")).otherwise(F.col("row.n_chars"))
        changed["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
