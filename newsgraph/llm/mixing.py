"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes by rank in which a source's running word counts are first summed, so that no source is one group.
RANK_BINS = 4096


def n_words(text: Column) -> Column:
    """How many runs of characters other than space and 0x09-0x0D the text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Words to take of each source: (source, source_size) -> (source, source_size, target).

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes. A
    target is at most `most` times its source's size; the rest is shared again by weight until
    none is above. That is target = min(most * size, level * weight) for one level, found by
    summing over the sources in the order in which they reach their limit. Both windows are over
    one row a source.
    """
    n = len(weights)
    # Strings compare as UTF-8 bytes, which is the order of code points.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % n + 1).cast("int")))
    by_limit = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    below = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(below), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    )
    limit = F.col("source_size") * most
    levels = weighed.withColumn("level", level).withColumn("free", F.when(F.col("level") * F.col("w") <= limit, F.struct(F.row_number().over(by_limit), "level")))
    # The level is that of the first source that does not reach its limit.
    found = levels.withColumn("level", F.min("free").over(everything)["level"])
    return found.select("source", "source_size", F.least(F.col("level") * F.col("w"), limit).cast("double").alias("target"))


def _inclusion_factor(classes: Column, rest: Column) -> Column:
    """The factor m with which the expected words of a source are `rest`: classes holds (weight w,
    words n), and a document of weight w is included with odds m * w. By bisection on log2(m)."""
    words = lambda x: F.aggregate(classes, F.lit(0.0), lambda acc, c: acc + c["n"] * c["w"] / (c["w"] + F.pow(F.lit(2.0), -x)))
    start = F.struct(F.lit(-80.0).alias("low"), F.lit(80.0).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        more = words(middle) < rest
        return F.struct(F.when(more, middle).otherwise(acc["low"]).alias("low"), F.when(more, acc["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda acc: F.pow(F.lit(2.0), (acc["low"] + acc["high"]) / 2))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 20240817,
    desire: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
) -> DataFrame:
    """Documents in whole copies so that each source's words come near its target.

    A source whose target is t times its size takes each document floor(t) times for certain. The
    words that are left are drawn by Pareto order sampling with unequal probabilities: a document's
    inclusion odds are m * desire, by default the square root of its size, so that longer documents
    are likelier; m is such that the expected words of the source are those left (desire counts in
    steps of a quarter of an octave, 2 ** -20 to 2 ** 20). With a uniform number u from a hash of
    the row and seed, a document's rank is its random odds u / (1 - u) divided by its inclusion
    odds, and the documents of least rank fill the words left, to within half a document. Sums over
    ranks are taken in two steps, by classes of the rank and within one, so that a source of any
    size is spread over many tasks.

    Returns the columns of docs and size, source_size, target, copies, taken (copies * size).
    Columns of docs with these names are replaced; size_col names one that holds the size already,
    else words of text_col are counted. Null text: size 0, taken 0. Null source: one source, last.
    Null or negative desire counts as 1. Equal rows have equal ranks; which of them is taken makes
    no difference. Rows with a null id or equal ids are drawn by all their columns. Empty table:
    none. Same input, same result.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in made]
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else n_words(F.col(text_col))
    wish = F.sqrt(size) if desire is None else desire.cast("double")
    level = F.round(4 * F.log2(F.when(wish > 0, wish).otherwise(1.0)))
    # The caller's columns stay in a struct of their own, so no name of theirs meets one of these.
    base = docs.select(F.struct(*own).alias("row"), size.alias("size"), F.col(source_col).alias("src"), F.greatest(F.lit(-80), F.least(F.lit(80), level)).alias("level"))
    mark = F.xxhash64(F.lit(seed), "row")
    base = base.withColumn("weight", F.pow(F.lit(2.0), F.col("level") / 4)).withColumn("mark", mark)
    classes = base.groupBy("src", "weight").agg(F.sum("size").alias("n"))
    sizes = classes.groupBy(F.col("src").alias("source")).agg(F.sum("n").alias("source_size"), F.collect_list(F.struct(F.col("weight").alias("w"), "n")).alias("classes"))
    plan = source_targets(sizes.select("source", "source_size"), weights, most).alias("p").join(sizes.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    plan = plan.select("p.*", "s.classes").withColumn("sure", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size"))
    plan = plan.select(
        F.col("source").alias("plan_src"),
        F.xxhash64(F.lit(seed), "source").alias("sid"),  # not null, for the keys below
        "source_size",
        "target",
        "sure",
        "rest",
        F.when(F.col("rest") > 0, _inclusion_factor(F.col("classes"), F.col("rest"))).alias("factor"),
    )
    # As many rows as sources: Spark broadcasts it while it is small, and else splits hot sources.
    rows = base.join(plan, F.col("src").eqNullSafe(F.col("plan_src")), "left")
    u = (F.pmod(F.xxhash64("mark"), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    rows = rows.withColumn("rank", u / (1 - u) / (F.col("factor") * F.col("weight")))
    drawn = F.col("rank").isNotNull()
    # Classes in the order of ranks. Rows that are not drawn have classes of their own, that they
    # do not meet in one task.
    place = F.col("rank") / (1 + F.col("rank"))
    rows = rows.withColumn("bin", F.when(drawn, F.least(F.floor(place * RANK_BINS), F.lit(RANK_BINS - 1))).otherwise(-1 - F.pmod("mark", F.lit(RANK_BINS))))
    bins = rows.filter(drawn).groupBy("sid", "bin").agg(F.sum("size").alias("in_bin"))
    earlier = Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("sid", "bin", F.coalesce(F.sum("in_bin").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("sid", "bin").orderBy("rank", "mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(bins, ["sid", "bin"], "left")
    middle = F.col("before") + F.sum("size").over(within) - F.col("size") / 2
    extra = F.when(drawn & (middle <= F.col("rest")), 1).otherwise(0)
    copies = (F.coalesce(F.col("sure"), F.lit(0)) + extra).cast("long")
    out = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("row.*", *made)
