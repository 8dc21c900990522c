"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Two multinomials over hashed word unigrams and bigrams are counted over whole texts: one over the
trusted target (documents that a label marks good) and one over the raw corpus (all documents). With
add-one smoothing each bucket gets log P(target) - log P(raw), rounded to a millionth so that sums are
whole numbers and never depend on their order. A document's score is the mean over its n-grams; it is
kept if no base rule fails it and its score reaches the threshold. The counts come from one pass that
ends in at most ``buckets`` rows a task; the ratios, ``buckets`` numbers, stand in the plan of the
second pass as a constant. That pass shuffles nothing. Only texts that may be trusted are shuffled to meet
their ids: a bit map of fixed size (4 MiB) of the hashes of the trusted ids lets the others by. It spares
fewer the fuller it is, and decides nothing: the join does.

Nulls and empty texts have no word: every statistic is 0 and the base rules fail them. Repeated rows
are counted and judged each. Without any trusted document all ratios are equal and only the base rules
decide. Labels that repeat an id count as trusted if any of them is. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import SPACE, durable, table, with_likely, words

WINDOW = 8
SCALE = 1_000_000


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """The buckets of all unigrams and bigrams, from the hashes of the words."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    twos = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of eight that the text holds twice or more."""
    n = F.size(hashes) - WINDOW + 1
    one = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        again = let(placed, lambda s: F.filter(s, lambda e, i: (e["h"] == F.get(s, i + 1)["h"]) | (e["h"] == F.get(s, i - 1)["h"])))
        at = F.sort_array(F.transform(again, lambda e: e["p"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    found = let(one, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)))
    return F.coalesce(found, F.lit(0)).cast("long")


def base_statistics(text: Column, hashes: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(hashes),
    }


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16) -> Column:
    """A constant array with the scaled log ratio of every bucket."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = base.schema["_id"].dataType
    good = durable(trusted.select(F.col(id_col).cast(id_type).alias("_id")).where("_id is not null").distinct())
    marked = with_likely(base, good)

    def grams(rows: DataFrame, is_good: Column) -> DataFrame:
        hashed = rows.select(is_good.alias("_good"), word_hashes(F.col("_text")).alias("_h"))
        return hashed.select("_good", F.explode(ngram_buckets(F.col("_h"), buckets)).alias("_b"))

    met = marked.where("_likely").join(good.withColumn("_is", F.lit(1)).hint("merge"), "_id", "left")
    both = grams(marked.where("not _likely"), F.lit(0)).union(grams(met, F.coalesce("_is", F.lit(0))))
    counts = both.groupBy("_b").agg(F.count("*").alias("_raw"), F.sum("_good").alias("_target"))
    all_ = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b")).join(counts, "_b", "left").fillna(0)
    sums = all_.agg(F.sum("_raw").alias("_raws"), F.sum("_target").alias("_targets"), F.array_sort(F.collect_list(F.struct("_b", "_raw", "_target"))).alias("_all"))

    def ratio(x: Column) -> Column:
        target = F.log((x["_target"] + 1) / (F.col("_targets") + buckets))
        return F.round((target - F.log((x["_raw"] + 1) / (F.col("_raws") + buckets))) * SCALE).cast("long")

    known = sums.select(F.array_join(F.transform("_all", lambda x: F.when(F.col("_targets") > 0, ratio(x)).otherwise(0).cast("string")), ",")).first()[0]
    return F.split(F.lit(known), ",").cast("array<bigint>")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, threshold: float = -0.06) -> DataFrame:
    """``id_col``, the base statistics, ``base_failed``, ``score`` and ``kept`` for every row of ``docs``.

    ``trusted`` holds the ids of the trusted target in ``id_col``.
    """
    known = ratios(docs, trusted, id_col, text_col, buckets)
    hashed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), word_hashes(F.col(text_col)).alias("_h"))
    total = let(ngram_buckets(F.col("_h"), buckets), lambda b: F.struct(F.size(b).cast("long").alias("n"), F.aggregate(b, F.lit(0).cast("long"), lambda a, i: a + F.get(known, i)).alias("sum")))
    # A row number is not deterministic, so the optimizer moves no filter on a verdict below this projection, where the
    # words would be hashed anew for every n-gram of every rule.
    judged = hashed.select("_id", F.monotonically_increasing_id().alias("_row"), *(c.alias(n) for n, c in base_statistics(F.col("_text"), F.col("_h")).items()), total.alias("_total"))
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > 30 * F.col("n_words"))
    score = F.coalesce(F.try_divide(F.col("_total.sum").cast("double"), F.col("_total.n") * SCALE), F.lit(0.0))
    scored = judged.withColumn("base_failed", F.when(F.col("_row") >= 0, failed)).withColumn("score", F.when(F.col("_row") >= 0, score)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return scored.drop("_total", "_row").withColumnRenamed("_id", id_col)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)
