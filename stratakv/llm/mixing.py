"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.llm.textio import named, written

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of a source's keys for every doubling of the key; only the slice in which the budget ends is sorted.
KEY_SLICES = 512


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """source, source_size -> target as well.

    Sources by code point, null last, take the weights in turn; together they get share times all sizes. A target
    stops at most_epochs times its source's size and the excess goes to the others by weight: with r the sources'
    most_epochs * size / weight in rising order, the first k are full for the k at which the rest's common level
    stays below the next r. One row per source, so the windows here hold as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.lit(float(most_epochs)) * F.col("source_size")
    level = (F.col("total") * share - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("full", full)
        .withColumn("room", F.col("full") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(every))
        .withColumn("target", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))))
        .select("source", "source_size", "target")
    )


def sampling_key(ident: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u in (0, 1) from the document's id: the smallest keys are a weighted sample without replacement."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most_epochs: float = 2.0,
    quality: Column | None = None,
    seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document the mix takes, with repeats: doc_id, size, source_size, target, taken.

    Each source gives floor(target / size) complete epochs; the rest of its target is filled by documents in the order
    of their sampling keys, where `quality` (default 1, null or not positive: 1) makes a document likelier to come
    early. The document in which the budget ends is taken up to it, so a source's taken words are floor(target).

    Sizes and keys are computed once and written. The prefix sums never sort a whole source: keys fall into
    KEY_SLICES slices for every doubling, whatever the scale of the weights, slices are summed before any shuffle, a window runs over the sums, and only documents of the
    slice in which the budget ends are ordered one by one, so a source with a third of all rows is spread over all
    tasks. Null text has size 0 and takes nothing; null sources form one source; rows with the same id and equal keys
    are ordered by size and any repeated row is a document of its own. `keep` names more columns to carry; columns of
    docs named like ours are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    weight = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    sized = docs.select(
        *[named(c).alias(f"kept_{i}") for i, c in enumerate(keep)],
        F.col("doc_id"),
        F.col("source"),
        size_in_words(F.col("text")).alias("size"),
        sampling_key(F.col("doc_id"), weight, seed).alias("key"),
    )
    sized = written(sized.withColumn("slice", F.floor(F.log2("key") * KEY_SLICES).cast("int")), "mix-sizes")
    summed = written(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"), F.count("*").alias("n")), "mix-slices")
    aims = targets(summed.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("epochs", epochs).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    order = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        summed.withColumn("before", F.coalesce(F.sum("slice_size").over(order), F.lit(0)))
        .join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("room", F.col("budget") - F.col("before"))
        .select("source", "slice", "slice_size", "source_size", "target", "epochs", "room")
    )
    plan = written(plan, "mix-plan")
    both = sized.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    plan = plan.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    both = both.join(plan, ["source_key", "slice"])
    within = Window.partitionBy("source_key", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "row")
    ends_here = (F.col("room") > 0) & (F.col("room") < F.col("slice_size"))
    cut = (
        both.where(ends_here)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("ahead", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("room") - F.coalesce("ahead", F.lit(0)))))
        .drop("row", "ahead")
    )
    rest = both.where(~ends_here).withColumn("part", F.when(F.col("room") > 0, F.col("size")).otherwise(0))
    return cut.unionByName(rest).select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )
