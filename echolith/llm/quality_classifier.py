"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are Spark columns. Small trees are grown on bootstraps of a bounded sample of
labelled rows (``most_rows``, taken by a hash of the id); the path to every node is a conjunctive rule.
A lasso logistic regression over the rules leaves few with a weight, and those are compiled back into
one Spark column, which scores every document beside its statistics. The trees and weights are fitted on
the driver, whose memory the bound keeps constant; everything else is one pass over the texts.

Nulls and empty texts have statistics of 0 and are scored like any other. Labels whose quality is null
are left out; an id with several labels counts with the largest, one with several texts is learned from the first of them in
order. With no label, or one class only, every
score is the smoothed share of label 1. Repeated rows get equal scores. Ids, labels, languages and
sources never enter a score. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import table, words

MOST_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; ``_w`` must hold its words."""
    n_chars, n_words = F.length(text), F.size("_w")
    lines = F.split(text, "\n", -1)

    def per(x: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), of), F.lit(0.0))

    def share(kind: str) -> Column:
        """Of characters of a kind: taken out by runs, which makes fewer strings than counting matches."""
        return per(n_chars - F.length(F.regexp_replace(text, f"{kind}+", "")), n_chars)

    return {
        "n_chars": n_chars.cast("double"),
        "n_words": n_words.cast("double"),
        "word_len": per(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), n_words),
        "distinct_words": per(F.size(F.array_distinct("_w")), n_words),
        "lines": per(F.size(lines), n_chars),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "upper": share(r"\p{Lu}"),
        "lower": share(r"\p{Ll}"),
        "digits": share("[0-9]"),
        "symbols": share("[#*$%&|<>@^~=+_{}\\\\]"),
        "stops": share("[.,;:]"),
        "cries": share("[!?]"),
        "other": share(r"[^\p{L}0-9\s.,;:!?'\"-]"),
        "short_words": per(F.regexp_count(text, F.lit(r"(?<![^\s])\S{1,3}(?!\S)")), n_words),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``statistic <= cut`` (True) or ``statistic > cut`` (False), and its weight."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        holds = F.lit(True)
        for name, below, cut in self.parts:
            holds = holds & (F.col(name) <= cut if below else F.col(name) > cut)
        return F.when(holds, F.lit(self.weight)).otherwise(F.lit(0.0))

    def holds(self, names: list[str], x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, below, cut in self.parts:
            v = x[:, names.index(name)]
            out &= v <= cut if below else v > cut
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + r.column()
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int = 3, cuts: int = 24) -> list[Rule]:
    """The rules of all nodes below the root of one tree on a bootstrap."""
    pick = rng.integers(0, len(x), len(x))
    found: list[Rule] = []

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        if not left or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best, n, ones = (1e-9, None, None), len(rows), y[rows].sum()
        for k in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
            v = x[rows, k]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, cuts))):
                below = v <= cut
                a, b = below.sum(), y[rows][below].sum()
                if 5 <= a <= n - 5:
                    gain = b * b / a + (ones - b) ** 2 / (n - a) - ones * ones / n
                    best = max(best, (gain, int(k), float(cut)), key=lambda t: t[0])
        if best[1] is None:
            return
        _, k, cut = best
        for side in (True, False):
            step = (*path, (names[k], side, cut))
            found.append(Rule(step))
            split(rows[(x[rows, k] <= cut) == side], step, left - 1)

    split(pick, (), depth)
    return found


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient; the bias is not penalised."""
    n, a = len(y), np.column_stack([np.ones(len(y)), r])
    step = 4 * n / np.linalg.norm(a, 2) ** 2
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -40, 40))) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 16, penalty: float = 0.002, seed: int = 7) -> Model:
    """A model from the statistics ``x`` of labelled rows, whose order fixes it."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    rules = list(dict.fromkeys(r for _ in range(trees) for r in grow(x, y, names, rng)))
    seen, kept = set(), []
    for r in rules:
        mark = r.holds(names, x)
        if (key := mark.tobytes()) not in seen and 0 < mark.sum() < len(mark):
            seen.add(key)
            kept.append((r, mark))
    bias, weights = lasso_logistic(np.column_stack([m for _, m in kept]).astype(float), y.astype(float), penalty)
    return Model(bias, tuple(Rule(r.parts, float(w)) for (r, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-6))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """A model from at most ``most_rows`` labelled rows, chosen by a hash of their id.

    Their ids, of that bounded number, are broadcast; statistics are worked out for their texts alone.
    """
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = labelled.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_text").alias("_text"))
    names = list(statistics(F.lit("")))
    known = sorted(described(texts, "_text").select("_keep._y", *names).collect())
    x = np.array([r[1:] for r in known], float).reshape(len(known), len(names))
    return fit(x, np.array([r[0] for r in known], float), names)


def described(docs: DataFrame, text_col: str) -> DataFrame:
    """``_keep``, a struct of all columns of ``docs``, ``_row``, and the statistics of the text.

    ``_row`` is not deterministic, so the optimizer moves no filter on a score below this projection:
    there it would work out the statistics anew for every part of every rule.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_keep"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).withColumn("_w", words(F.col("_text")))
    return whole.select("_keep", F.monotonically_increasing_id().alias("_row"), *(c.alias(n) for n, c in statistics(F.col("_text")).items()))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``_keep``, a struct of all columns of ``docs``, and ``_score``; one pass, no shuffle."""
    return described(docs, text_col).select("_keep", F.when(F.col("_row") >= 0, model.column()).alias("_score"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``."""
    model = train(docs, labels, id_col, text_col, label_col, most_rows)
    out = scored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text").select(F.col("_keep._id").alias(id_col), F.col("_score").alias("score"))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    model = train(docs, labels, **how)
    return scored(docs, model, how.get("text_col", "text")).where(F.col("_score") >= threshold).select("_keep.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
