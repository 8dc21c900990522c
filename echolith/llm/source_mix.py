"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets: the sources share the total by weight; none is asked for more than ``most`` times its size,
and what that frees goes to the others by weight. The fixed point comes in closed form: sources sorted
by size against weight are full up to one place, and the rest share what is left.

Selection: a target of e full sizes and a rest takes every document e times (complete epochs) and the
rest by sampling without replacement: each document draws u in (0, 1) from a digest of its id, its key
is -ln(u) / weight, and documents are taken in the order of their keys until their sizes fill the rest.
The document on the boundary is taken if that leaves the source nearer to its target.

A source is never sorted in one place. Keys are kept as logarithms, ``ln(-ln(u)) - ln(weight)``: the bulk of any
set of weights from 1e-6 up spreads over them, and none runs out of digits. Each step of ``scales`` bins them more finely, and
only in the one bin on the boundary that the step before found, so a step sums a bounded number of bins a source
(about 50 << 10 at first, 4,096 later), whatever the data. What is left in the last boundary bin is summed by (key, id,
size); of rows equal in all three, which are interchangeable, a number is taken, counted by where they are stored.

Nulls: a null text has size 0, a null source is a source of its own (last in order), a null id draws
the digest of the empty string. Documents of equal key are ordered by id (nulls first), then size. Sources of size 0 get target 0. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolith.llm.common import durable, n_words, stored, table

WEIGHTS = (5, 2, 1)
#: Binary digits behind the point of a key that each step bins by.
SCALES = (10, 22, 34)


def letter_share(text: Column) -> Column:
    """A quality weight from 0.1 to 1: the share of a text's visible characters that are letters."""
    text = F.coalesce(text, F.lit(""))
    shown = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]"))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"\p{L}")), shown), F.lit(0.1)))


def draw(id_: Column) -> Column:
    """A number in (0, 1) from the digest of an id: 48 of its bits, so SQL engines agree on it."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``_key, source_size, docs, target`` from ``_key, _source, _size``; one row for each source."""
    sums = sized.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sums.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    heft = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights) + 1).cast("double")
    weighed = ranked.withColumn("_heft", heft).withColumn("_full", (F.col("source_size") * most).cast("double"))
    fuller = Window.orderBy(F.col("_full") / F.col("_heft"), "_rank").rowsBetween(Window.unboundedPreceding, -1)

    def left(total: str, spent: str) -> Column:
        return F.sum(total).over(every) - F.coalesce(F.sum(spent).over(fuller), F.lit(0.0))

    level = weighed.withColumn("_level", left("source_size", "_full") / left("_heft", "_heft"))
    # Levels fall along this order; the first that its source can take is the level of it and of all after it.
    shared = F.max(F.when(F.col("_level") * F.col("_heft") <= F.col("_full"), F.col("_level"))).over(every)
    target = F.least("_full", F.coalesce(shared * F.col("_heft"), F.col("_full")))
    return level.withColumn("target", target).select("_key", "source_size", "docs", "target")


def lean(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table with a row a source, to be broadcast if it is seen to have ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def epochs_and_rest() -> tuple[Column, Column]:
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    return epochs, F.col("target") - epochs * F.col("source_size")


def bin_of(scale: int) -> Column:
    return F.floor(F.col("_z") * float(1 << scale))


def cuts(base: DataFrame, goal: DataFrame, scales: tuple[int, ...]) -> DataFrame:
    """``_key, _bin, _cut, _n, _copies`` for each source that has a rest.

    ``_bin`` is the bin (of the last scale) in which the rest ends, ``_cut`` the last ``(_z, _id, _size)`` in it that is taken,
    if any, ``_n`` how many rows have it and ``_copies`` how many of them are taken.
    """
    bounds = goal.select("_key", epochs_and_rest()[1].alias("_rest"), F.lit(0).cast("long").alias("_before")).where("_rest > 0")
    inside, on = base, ["_key"]

    def summed(at: str) -> DataFrame:
        """The groups of ``at`` in the open bin, with the sizes before and up to each."""
        sums = inside.groupBy(*on, at).agg(F.sum("_size").alias("_sum"), F.count("*").alias("_n"))
        upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        known = sums.join(lean(bounds), on).withColumn("_upto", F.col("_before") + upto)
        return known.withColumn("_before", F.col("_upto") - F.col("_sum"))

    for scale in scales:
        inside = inside.withColumn("_next", bin_of(scale))
        bounds = durable(summed("_next").where("_before < _rest and _upto >= _rest").select("_key", F.col("_next").alias("_bin"), "_rest", "_before"))
        on = ["_key", "_bin"]
        inside = base.withColumn("_bin", bin_of(scale)).join(lean(bounds.select(*on)), on, "left_semi")
    inside = inside.withColumn("_cut", F.struct("_z", "_id", "_size"))
    # A document is taken if what stands before it and half of it fit.
    each = F.col("_cut._size")
    copies = F.when(each > 0, F.least(F.col("_n"), F.floor((F.col("_rest") - F.col("_before") + each / 2) / each))).otherwise(F.col("_n"))
    last = summed("_cut").select("_key", F.struct("_cut", "_n", copies.cast("long").alias("_copies")).alias("_m")).where("_m._copies > 0")
    return bounds.select("_key", "_bin").join(last.groupBy("_key").agg(F.max("_m").alias("_m")), "_key", "left").select("_key", "_bin", "_m.*")


def beyond(base: DataFrame, partial: DataFrame) -> DataFrame:
    """``_key, _row`` of the rows that tie with a cut and are not taken; ties are numbered part by part, as they are stored."""
    tied = F.struct("_z", "_id", "_size").eqNullSafe(F.col("_cut"))
    ties = base.join(lean(partial), "_key").where(tied).select("_key", "_row", "_copies", F.shiftright("_row", 33).alias("_part"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ties.groupBy("_key", "_part").agg(F.count("*").alias("_n")).select("_key", "_part", F.coalesce(before, F.lit(0)).alias("_earlier"))
    within = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_row"))
    return ties.join(parts, ["_key", "_part"]).withColumn("_nth", within + F.col("_earlier")).where("_nth > _copies").select("_key", "_row")


def mix(docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, scales: tuple[int, ...] = SCALES, keep: bool = False) -> DataFrame:
    """``id_col, source, size, source_size, target, taken`` for every row of ``docs``.

    ``weight`` is a positive column of ``docs`` (by default the share of letters); weights below 1e-6 count as that.
    With ``keep`` the rows have all columns of ``docs`` and behind them the last four (in place of those of their names).
    """
    text, source = F.col(text_col), F.col(source_col)
    weight = F.greatest(F.coalesce((letter_share(text) if weight is None else weight).cast("double"), F.lit(0.0)), F.lit(1e-6))
    base = docs.select(F.col(id_col).alias("_id"), source.alias("_source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_key"), n_words(text).alias("_size"), weight.alias("_w"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_keep")] if keep else []))
    z = F.log(-F.log(draw(F.col("_id")))) - F.log("_w")
    base = stored(base.select("_id", "_source", "_key", "_size", z.alias("_z"), F.monotonically_increasing_id().alias("_row"), *(["_keep"] if keep else [])))
    goal = durable(targets(base, weights, most))
    found = durable(cuts(base, goal, scales))
    known = base.join(lean(goal.drop("docs")), "_key").join(lean(found), "_key", "left")
    if not (partial := found.where("_copies < _n")).isEmpty():
        known = known.join(beyond(base, partial).withColumn("_beyond", F.lit(True)), ["_key", "_row"], "left")
    else:
        known = known.withColumn("_beyond", F.lit(None).cast("boolean"))
    epochs, rest = epochs_and_rest()
    own = bin_of(scales[-1])
    first = (own < F.col("_bin")) | ((own == F.col("_bin")) & (F.struct("_z", "_id", "_size") <= F.col("_cut")) & F.col("_beyond").isNull())
    again = F.when((rest > 0) & first, 1).otherwise(0)
    taken = (F.col("_size") * (epochs + again)).cast("long")
    if keep:
        own = [F.col("_size").alias("size"), F.col("source_size"), F.col("target"), taken.alias("taken")]
        return known.select(*(F.col(f"_keep.`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "taken")), *own)
    return known.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


#: The mix over the rows of a view ``{docs}``; used for the documents and for the pipeline.
SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         greatest(0.1, coalesce(len(regexp_extract_all(coalesce(text, ''), '\p{L}'))::double
           / nullif(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]')), 0), 0.1)) as w,
         ((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint)::double + 0.5) / 281474976710656.0 as u
  from {docs}
), sums as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rnk from sized group by source
), weighed as (
  select *, (case (rnk - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as heft, (source_size * 3)::double as cap from sums
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over f, 0.0)) / (sum(heft) over () - coalesce(sum(heft) over f, 0.0)) as level
  from weighed window f as (order by cap / heft, rnk rows between unbounded preceding and 1 preceding)
), goals as (
  select source, source_size, least(cap, coalesce(max(case when level * heft <= cap then level end) over () * heft, cap)) as target from levels
), keyed as (
  select sized.doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as epochs,
         sum(size) over (partition by sized.source order by pow(u, 1 / w) desc, sized.doc_id, size rows between unbounded preceding and current row) as upto
  from sized join goals on sized.source is not distinct from goals.source
)
select doc_id, size, source_size, target,
       (size * (epochs + case when target - epochs * source_size > 0 and upto - (target - epochs * source_size) <= target - epochs * source_size - upto + size then 1 else 0 end))::bigint as taken
from keyed
"""
ORACLE = SQL.replace("{docs}", "documents")
