"""Quality classifier: rules from tree paths, weighed by a lasso, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import saved, words_of

# The classifier is fitted on at most so many labelled rows, those with the smallest hash
# of their doc_id.
TRAIN_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
LASSO = 2e-4
THRESHOLD = 0.3

# One labelled row in so many is held out.
FOLDS = 5

Rule = tuple[tuple[int, float, bool], ...]  # (feature, bound, whether above it)


# --- statistics ---------------------------------------------------------------------------

def _count(pattern: str) -> Column:
    """Characters of a class in the text."""
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def _statistics() -> dict[str, Column]:
    """Statistics of a text and its ``_words`` and ``_lines``; 0 where there is nothing to
    divide by."""
    words, chars = F.size("_words"), F.length("text")

    def per(value: Column, base: Column) -> Column:
        return F.when(base > 0, value / base).otherwise(0.0)

    next_same = F.zip_with("_words", F.slice("_words", 2, words), lambda a, b: a.eqNullSafe(b))
    return {
        "upper": per(_count(r"\p{Lu}+"), chars),
        "symbols": per(_count(r"[#*$%&<>@^~=+]+"), words),
        "bars": per(_count(r"[|]+"), words),
        "marks": per(_count(r"[!?]+"), words),
        "stops": per(_count(r"[.,;:]+"), words),
        "digits": per(_count(r"[0-9]+"), chars),
        "distinct": per(F.size(F.array_distinct("_words")), words),
        "stutter": per(F.size(F.filter(next_same, lambda x: x)), words),
        "word_length": per(F.length(F.array_join("_words", "")), words),
        "line_words": per(words, F.size("_lines")),
        "line_repeats": per(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines")),
        "log_words": F.log1p(words),
    }


FEATURES = ("upper", "symbols", "bars", "marks", "stops", "digits", "distinct", "stutter", "word_length", "line_words", "line_repeats", "log_words")


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features of each whole text; a NULL text is empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_words": words_of(F.col("text")), "_lines": F.split("text", "\n", -1)})
    return rows.select("doc_id", *[c.cast("double").alias(n) for n, c in _statistics().items()])


# --- rules from trees -----------------------------------------------------------------------

def _bounds(x: np.ndarray) -> list[np.ndarray]:
    """Split bounds of each feature: its distinct quantiles."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]


def _best_split(binned: np.ndarray, sizes: Sequence[int], gradient: np.ndarray, weight: np.ndarray) -> tuple[int, int] | None:
    """Feature and bin whose split explains the gradient best."""
    best, found = 1e-6, None
    total, mass = gradient.sum(), weight.sum()
    for j, size in enumerate(sizes):
        if not size:
            continue
        g = np.bincount(binned[:, j], gradient, size + 1).cumsum()[:-1]
        h = np.bincount(binned[:, j], weight, size + 1).cumsum()[:-1]
        gain = g**2 / (h + 1) + (total - g) ** 2 / (mass - h + 1) - total**2 / (mass + 1)
        gain[(h < 0.5) | (mass - h < 0.5)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k)
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[Rule]:
    """Paths of boosted trees, inner nodes too. Each tree sees half of the rows and what
    the trees before it leave unexplained."""
    bounds = _bounds(x)
    sizes = [len(b) for b in bounds]
    binned = np.column_stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T)])
    random = np.random.RandomState(seed)
    odds, rules = np.full(len(y), 0.0), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        sample = random.rand(len(y)) < 0.5
        nodes: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(y), bool))]
        for _ in range(depth):
            grown = []
            for path, inside in nodes:
                own = inside & sample
                split = _best_split(binned[own], sizes, gradient[own], weight[own]) if own.sum() > 20 else None
                if split is None:
                    grown.append((path, inside))
                    continue
                j, k = split
                for above in (False, True):
                    rule = (*path, (j, float(bounds[j][k]), above))
                    rules.setdefault(tuple(sorted(set(rule))))
                    grown.append((rule, inside & ((binned[:, j] > k) == above)))
            nodes = grown
        for _, inside in nodes:
            odds[inside] += 0.3 * gradient[inside].sum() / (weight[inside].sum() + 1)
    return list(rules)


def rule_matrix(x: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    found = np.ones((len(x), len(rules)), np.float32)
    for r, rule in enumerate(rules):
        for j, bound, above in rule:
            found[:, r] *= (x[:, j] > bound) == above
    return found


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is free."""
    n, m = a.shape
    y = y.astype(np.float32)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w, b = np.zeros(m, np.float32), float(np.log(mean / (1 - mean)))
    if not m:
        return w, b
    probe = np.ones(m, np.float32)
    for _ in range(20):
        probe = a.T @ (a @ probe)
        probe /= np.linalg.norm(probe) or 1.0
    rate = 4 * n / (float(np.linalg.norm(a @ probe)) ** 2 + n)
    look, look_b, t = w, b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(a @ look + np.float32(look_b)))) - y
        stepped = look - np.float32(rate / n) * (a.T @ error)
        new = np.sign(stepped) * np.maximum(np.abs(stepped) - np.float32(rate * penalty), 0)
        new_b = look_b - rate * float(error.mean())
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, look_b = new + np.float32((t - 1) / after) * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the intercept. Rules that hold for the same rows are
    one; those that hold for nearly all or none are left out."""
    if not len(y):
        return [], 0.0
    rules = tree_rules(x, y) if 0 < y.mean() < 1 else []
    a = rule_matrix(x, rules)
    seen, keep = set(), []
    for r in range(len(rules)):
        column = a[:, r].tobytes()
        if 0.002 < a[:, r].mean() < 0.998 and column not in seen:
            seen.add(column)
            keep.append(r)
    w, b = lasso_logistic(a[:, keep], y)
    return [(rules[r], float(v)) for r, v in zip(keep, w) if v], b


def score_column(rules: Sequence[tuple[Rule, float]], intercept: float) -> Column:
    """The fitted rules as one expression over the features."""

    def holds(rule: Rule) -> Column:
        return reduce(and_, [F.col(FEATURES[j]) > bound if above else F.col(FEATURES[j]) <= bound for j, bound, above in rule])

    parts = [F.when(holds(rule), F.lit(weight)).otherwise(0.0) for rule, weight in rules]
    odds = reduce(add, parts, F.lit(float(intercept)))
    return 1 / (1 + F.exp(-odds))


def held_out(folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Statistics of whole texts are the only inputs. Paths of small boosted trees over them
    become rules, a lasso logistic regression weighs the rules, and the few that keep a
    weight are compiled into column expressions. Trees and weights are fitted on at most
    ``train_rows`` labelled documents that are not held out.

    Empty and NULL texts get the score of their statistics, which are 0. Labels that are
    NULL, or whose document is not there, teach nothing; of several labels of a document
    the largest counts. Without labels every score is 0.5. A NULL doc_id is not held out.
    Rows that repeat a document are each scored; an empty table gives an empty result.
    """
    rows = saved(text_statistics(docs), "statistics")
    taught = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = rows.where(~held_out()).join(taught, "doc_id")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("quality", *FEATURES).collect()
    table = np.array([tuple(r) for r in sample], float).reshape(-1, len(FEATURES) + 1)
    rules, intercept = fit_rules(table[:, 1:], (table[:, 0] > 0).astype(float))
    scored = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(rules, intercept).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
