"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, table

#: Rows of one source that share a hash prefix, on average at most; only the prefix in which a source's share ends is sorted.
SLICE_ROWS = 2_000
#: A plan for so many sources, a row of some 100 bytes each, is broadcast; one for more is joined by source.
FEW_SOURCES = 50_000


def words(col: str) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds weight and target to (source, source_size). The table has one row for each source, so its global windows sort
    sources, never documents.

    Sources in order by code point, null last, take the weights in turn. All sizes are shared by weight; a source stops at
    max_epochs times its size, and the excess goes to the others by weight until none is above. Sorted by size over weight,
    the sources that stop are a prefix: each is tested against the level that the rest would get.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("double") for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("all_weights", F.sum("weight").over(whole))
    levels = levels.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = levels.withColumn("stops", F.col("level") * F.col("weight") >= F.col("cap"))
    levels = levels.withColumn("final", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"])
    return levels.select("source", "source_size", "weight", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _stamp(id_col: Column, seed: int) -> Column:
    """The seeded order's key of an id; null ids hash as empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def _planned(sized: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> tuple[DataFrame, int]:
    """(s, source_size, target, whole, goal, slice, start) of each source, a row each, broadcast if sources are few; and by how
    many digits of their stamps rows are cut into slices.

    A row is taken `whole` times, and once more if its slice comes before `slice`. There the share ends: of the rows in that
    one, those are taken whose words, counted from `start` on, come nearest to `goal`.
    """
    sources = table(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources", thin=True)
    largest, many = sources.agg(F.max("n"), F.count(F.lit(1))).first()
    digits = 1
    while 16**digits * SLICE_ROWS < (largest or 0):
        digits += 1
    shares = targets(sources.drop("n"), max_epochs, weights)
    shares = shares.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    shares = shares.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    slices = sized.groupBy("source", F.substring("stamp", 1, digits).alias("slice")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("slice")
    slices = slices.withColumn("end", F.sum("words").over(run)).withColumn("start", F.col("end") - F.col("words"))
    ends = slices.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("end >= goal").groupBy("source").agg(F.min(F.struct("slice", "start")).alias("last"))
    plan = shares.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = table(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "goal", F.col("last.slice").alias("slice"), F.col("last.start").alias("start")), "shares")
    return (F.broadcast(plan) if many <= FEW_SOURCES else plan), digits


def _edge(sized: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """The rows of sized in the slice in which their source's share ends, with the plan and `more`: are they taken once more?"""
    within = Window.partitionBy("source").orderBy("stamp", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).where(F.substring("stamp", 1, digits) == F.col("slice"))
    cut = cut.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return cut.withColumn("more", (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("goal")))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return table(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size")).withColumn("stamp", _stamp(F.col("doc_id"), seed)), "sizes")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row for each row of df: doc_id, source, size, source_size, target, repeats, taken.

    A document's size is its number of words. A source whose target is e times its size takes every document floor(e)
    times, and once more those first in a seeded order (md5 of seed and id, then id), up to the one nearest to the
    remaining share. So a source's taken words differ from its target by half a document at most, and reruns agree.
    Documents without words are taken floor(e) times.

    The order is cut into slices by hash prefix; sums of slices tell in which slice a source's share ends, and only that
    slice is sorted, so that no task holds a hot source. Null texts have size 0; null sources are one source; null ids hash
    as empty text; repeated rows count each. An empty table gives no rows.
    """
    sized = _sized(df, id_col, text_col, source_col, seed)
    plan, digits = _planned(sized, max_epochs, weights)
    out = lambda rows, more: rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).alias("repeats"))
    place = F.substring("stamp", 1, digits)
    sure = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).where(~F.coalesce(place == F.col("slice"), F.lit(False)))
    told = out(sure, (place < F.col("slice")) & (F.col("size") > 0)).unionByName(out(_edge(sized, plan, digits), F.col("more")))
    return told.withColumn("taken", F.col("size") * F.col("repeats"))


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of df as often as mix takes them, with all their columns, whatever their names.

    How often follows from a row's source and stamp alone, but in the slice in which its source's share ends; so rows meet
    the plan by a broadcast, and only that slice's rows are shuffled. Of rows that share id and source, all are repeated as
    often as the most repeated one. Nulls, empty texts and empty tables are as in mix.
    """
    sized = _sized(df, id_col, text_col, source_col, seed)
    plan, digits = _planned(sized, max_epochs, weights)
    some = F.coalesce(F.regexp_like(F.col(text_col), F.lit(f"[^{SPACE}]")), F.lit(False))
    rows = df.select(F.struct("*").alias("row"), F.col(source_col).alias("of"), _stamp(F.col(id_col), seed).alias("stamp"), some.alias("some"))
    rows = rows.join(plan.select("s", "whole", "slice"), F.col("of").eqNullSafe(F.col("s")))
    place = F.substring("stamp", 1, digits)
    edge = F.coalesce(place == F.col("slice"), F.lit(False))
    sure = rows.where(~edge).select("row", (F.col("whole") + F.coalesce(F.col("some") & (place < F.col("slice")), F.lit(False)).cast("long")).alias("times"))
    more = _edge(sized, plan, digits).groupBy(F.col("source").alias("at"), F.col("stamp").alias("mark")).agg(F.max("more").alias("more"))
    last = rows.where(edge).join(more, F.col("of").eqNullSafe(F.col("at")) & (F.col("stamp") == F.col("mark"))).select("row", (F.col("whole") + F.col("more").cast("long")).alias("times"))
    return sure.unionByName(last).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")
