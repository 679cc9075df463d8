"""Guards and control: admission, batches, pinned evidence, citations, matrices, unique cases, readiness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admitted(log: DataFrame, key: str, at: str, limits: dict[int, int]) -> DataFrame:
    """(key, at, admitted): requests in order; one is denied when a span of seconds is full, and then doesn't count.

    What is admitted depends on what was, so each key's requests are folded in order by Spark's array functions: the state
    holds the admitted times that a span can still reach.
    """
    longest = max(limits)
    listed = log.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("times"))
    zero = F.struct(F.array().cast("array<bigint>").alias("live"), F.array().cast("array<boolean>").alias("told"))

    def step(acc: Column, t: Column) -> Column:
        live = F.filter(acc["live"], lambda x: x > t - longest)
        ok = F.lit(True)
        for seconds, most in limits.items():
            ok = ok & (F.size(F.filter(live, lambda x: x > t - seconds)) < most)  # noqa: B023
        return F.struct(F.when(ok, F.concat(live, F.array(t))).otherwise(live).alias("live"), F.concat(acc["told"], F.array(ok)).alias("told"))

    told = listed.withColumn("told", F.aggregate("times", zero, step, lambda acc: acc["told"]))
    return told.select(key, F.inline(F.arrays_zip("times", "told"))).toDF(key, at, "admitted")


def batches(costs: Column, most: int, budget: int) -> Column:
    """The number of each item's batch: a new one begins when the count or the costs would go over."""
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("cost"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, cost: Column) -> Column:
        full = (acc["n"] >= most) | ((acc["n"] > 0) & (acc["cost"] + cost > budget))
        batch = acc["batch"] + full.cast("int")
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), F.when(full, cost.cast("long")).otherwise(acc["cost"] + cost).alias("cost"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(costs, zero, step, lambda acc: acc["out"])


def pinned_first(hits: DataFrame, pins: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, place): pinned documents in their order, then hits by rank, each document once, k in all."""
    p = pins.select("query_id", "doc_id", F.lit(0).alias("group"), F.col("position").alias("at"))
    h = hits.select("query_id", "doc_id", F.lit(1).alias("group"), F.col("rank").alias("at"))
    first = p.union(h).groupBy("query_id", "doc_id").agg(F.min(F.struct("group", "at")).alias("by"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("by"))).where(F.col("place") <= k).drop("by")


def rerank(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """Hits by a provider's score of (question, body); a score that isn't finite is an error. Each worker loads it once."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for question, body in parts:
            out = score(question, body).astype(float)
            if not out.map(lambda x: abs(x) < float("inf")).all():
                raise ValueError("a score isn't finite")
            yield out

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("score", scored("question", "body")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def verdicts(answers: DataFrame) -> DataFrame:
    """Adds verdict. answers: (cited, relevant, figures: array of verdicts). Citations outside the relevant evidence, and
    figures that fail, downgrade an answer; the worst figure counts."""
    outside = F.size(F.array_except("cited", "relevant")) > 0
    worst = F.when(F.array_contains("figures", "unverified"), "NOT_IN_DOCS").when(F.array_contains("figures", "period_mismatch"), "PERIOD_MISMATCH")
    return answers.withColumn("verdict", F.when(outside | (F.size("cited") == 0), "NOT_IN_DOCS").otherwise(F.coalesce(worst, F.lit("SUPPORTED"))))


def experiment_matrix(targets: DataFrame, strategies: DataFrame, rankers: DataFrame) -> DataFrame:
    """All arms of an experiment; the vector strategy has no ranker. The axes are a few rows each."""
    pairs = strategies.join(rankers, F.col("strategy") != "vector", "left")
    return targets.join(pairs, F.lit(True))


def both_languages(arms: DataFrame, identity: list[str]) -> DataFrame:
    """Arms that exist in two languages, which parity needs."""
    return arms.groupBy(*identity).agg(F.count_distinct("language").alias("n")).where("n = 2").drop("n")


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, if no key is blank or repeats; else an error that names some."""
    for k in keys:
        bad = rows.groupBy(F.trim(F.col(k).cast("string")).alias("v")).count().where("v IS NULL OR v = '' OR count > 1").take(3)
        if bad:
            raise ValueError(f"{k}: {[r.v for r in bad]}")
    return rows


def require_fresh(index_fingerprint: str, current: str) -> None:
    """An index that was built from other rows is refused."""
    if index_fingerprint != current:
        raise ValueError("the index is stale")


def readiness(chunks: DataFrame, vectors: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row: chunks, chunks without a vector of their text, whether statistics exist, and the first blocker."""
    n = chunks.join(vectors.select("chunk_id", "sha256", F.lit(1).alias("has")), ["chunk_id", "sha256"], "left").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("has").isNull()).alias("missing"))
    s = statistics.agg((F.count(F.lit(1)) > 0).alias("statistics"))
    blocker = F.when(F.col("chunks") == 0, "no_chunks").when(F.col("missing") > 0, "missing_vectors").when(~F.col("statistics"), "no_statistics")
    return n.join(s, F.lit(True)).withColumn("blocker", blocker)


def twin_alignment(pairs: DataFrame) -> DataFrame:
    """Mean, least and largest cosine of paired vectors (a, b)."""
    from lodestone.functions.vectors import cosine

    c = pairs.select(cosine(F.col("a"), F.col("b")).alias("c"))
    return c.agg(F.avg("c").alias("mean"), F.min("c").alias("least"), F.max("c").alias("largest"))
