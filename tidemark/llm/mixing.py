"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

*Targets.*  The sources, by code point with null last, have the weights in turn and share all words by weight; no
target exceeds ``cap`` times its source's words, and what is above goes to the others by weight until none is above.
That is ``min(cap * words, level * weight)`` for one level, found from running sums over the sources.

*Expected copies.*  Within a source a document's expected number of copies depends on its size class, the number of
binary digits of its word count: ``min(cap, level * 2 ** (tilt * class))``, with the level that meets the target, so a
document of twice the words is ``2 ** tilt`` times as likely to be taken.  The whole part are certain copies; the
fraction p is the chance of one more.

*Order sampling.*  The extra copies of a source are its documents of smallest ``odds(U) / odds(p)``, U being uniform
and repeatable from the document's values, up to the words that the target leaves.  The cut lies in one of
``BINS`` bins of that rank; only the documents of the cut's own bin are put in order, so a source that holds a third
of all rows needs no sort of its rows.  The cut is off the target by half a document at most.

Results: a null text has size 0.  Rows alike in doc_id, source and size share one decision.  Size-0 rows take
0 words.  An empty table gives an empty result.  Very long texts are rows like others.  Other columns, whatever their
names, travel inside one struct.  The sources are one row each and must fit one task, as a million do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, unit, words

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
TILT = 0.1
BINS = 4096


def fill(df: DataFrame, keys: list[str], size: str, weight: str, total: str, cap: float, out: str) -> DataFrame:
    """``out`` = min(cap * size, level * weight), with the level at which a group's sum is its ``total``."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by = group.orderBy(F.col(size) / F.col(weight), F.col(size), F.col(weight))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.col(total) - cap * F.coalesce(F.sum(size).over(before), zero)) / (F.sum(weight).over(group) - F.coalesce(F.sum(weight).over(before), zero))
    ranked = df.withColumn("_level", level).withColumn("_below", F.col("_level") * F.col(weight) <= cap * F.col(size))
    first = F.min_by(F.when(F.col("_below"), F.col("_level")), F.when(F.col("_below"), F.col(size) / F.col(weight))).over(group)
    return ranked.withColumn("_at", first).withColumn(out, F.least(cap * F.col(size), F.coalesce(F.col("_at") * F.col(weight), cap * F.col(size)))).drop("_level", "_below", "_at")


def _odds(p: Column) -> Column:
    return p / (1 - p)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """key, source_size (long), target (double) for each source; ``sized`` has source, key, size, rows."""
    sums = sized.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    # One row a source, from here on.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    given = sums.withColumn("w", pick).withColumn("s", F.col("source_size").cast("double")).withColumn("all", F.sum("s").over(Window.partitionBy(F.lit(0))))
    return fill(given, [], "s", "w", "all", float(cap), "target").select("key", "source_size", "target")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, tilt: float = TILT, seed: int = 7) -> DataFrame:
    """One row for each distinct (doc_id, source, size): rows (how often it occurs), source_size, target, copies."""
    picked = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.size(words(docs[text_col])).cast("long").alias("size"))
    sized = materialize(picked.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n"))).withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    targets = source_targets(sized, weights, cap)

    classes = sized.groupBy("key", "class").agg(F.sum(F.col("size") * F.col("rows")).cast("double").alias("s")).join(targets, "key")
    tilted = classes.withColumn("w", F.when(F.col("s") > 0, F.col("s")).otherwise(1e-9) * F.pow(F.lit(2.0), F.lit(tilt) * F.col("class")))
    filled = fill(tilted, ["key"], "s", "w", "target", float(cap), "words")
    copies = filled.withColumn("mean", F.when(F.col("s") > 0, F.least(F.lit(float(cap)), F.col("words") / F.col("s"))).otherwise(0.0))
    # A mean within rounding of a whole number is that number.
    near = F.abs(F.col("mean") - F.round("mean")) < 1e-9
    copies = copies.withColumn("mean", F.when(near, F.round("mean")).otherwise(F.col("mean")))
    copies = copies.withColumn("whole", F.floor("mean")).withColumn("p", F.col("mean") - F.col("whole"))
    left = F.col("target") - F.sum(F.col("whole") * F.col("s")).over(Window.partitionBy("key"))
    plan = materialize(copies.withColumn("left", left).select("key", "class", "source_size", "target", "whole", "p", "left"), "mix-plan")

    u = unit(F.lit(seed), "doc_id", "source", "size")
    ranked = sized.join(plan, ["key", "class"]).withColumn("q", F.when(F.col("p") > 0, _odds(u) / _odds(F.col("p"))))
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS)).withColumn("mass", F.col("size") * F.col("rows"))
    bins = ranked.where("p > 0").groupBy("key", "bin").agg(F.sum("mass").alias("in_bin"))
    upto = F.sum("in_bin").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("before", F.coalesce(upto, F.lit(0)))
    placed = ranked.join(bins, ["key", "bin"], "left")
    known = F.when(F.col("p") <= 0, 0).when(F.col("before") + F.col("in_bin") <= F.col("left"), 1).when(F.col("before") > F.col("left"), 0)
    placed = placed.withColumn("extra", known)
    inside = F.sum("mass").over(Window.partitionBy("key", "bin").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.where("extra is null").withColumn("extra", (F.col("before") + inside - F.col("mass") / 2 <= F.col("left")).cast("int"))
    out = ["doc_id", "source", "size", "rows", "source_size", "target"]
    return placed.where("extra is not null").unionByName(cut).select(*out, (F.col("whole") + F.col("extra")).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies."""
    each = decide(docs, **options).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns unchanged.  A row of no words stays once."""
    chosen = decide(docs, id_col, text_col, source_col, **options)
    chosen = chosen.select(*[F.col(c).alias(f"c_{c}") for c in ("doc_id", "source", "size")], F.when(F.col("size") > 0, F.col("copies")).otherwise(1).alias("times")).where("times > 0")
    whole = F.struct(*[docs[c] for c in docs.columns])  # so that no column can clash
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.size(words(docs[text_col])).cast("long").alias("size"), whole.alias("row"))
    same = [rows[c].eqNullSafe(chosen[f"c_{c}"]) for c in ("doc_id", "source", "size")]
    return rows.join(chosen, same).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
