"""Evaluation: span coverage, recall, hit rate and reciprocal rank, latencies, regression and parity gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.spans import overlap


def relevance(hits: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, gold_no, rank, relevant): does a hit cover at least `threshold` of a gold span of the same document?"""
    h = hits.select("query_id", "doc_id", "rank", F.col("start_char").alias("h_start"), F.col("end_char").alias("h_end"))
    both = gold.join(h, ["query_id", "doc_id"])
    share = overlap(F.col("start_char"), F.col("end_char"), F.col("h_start"), F.col("h_end")) / (F.col("end_char") - F.col("start_char"))
    return both.select("query_id", "gold_no", "rank", (share >= threshold).alias("relevant"))


def case_scores(cases: DataFrame, hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, hit, reciprocal_rank, first_rank) of each case that has gold spans, within the first k hits."""
    judged = relevance(hits.where(F.col("rank") <= k), gold).groupBy("query_id", "gold_no").agg(F.max("relevant").alias("found"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("at"))
    all_gold = gold.select("query_id", "gold_no").distinct().join(judged, ["query_id", "gold_no"], "left")
    per = all_gold.groupBy("query_id").agg(F.avg(F.coalesce("found", F.lit(False)).cast("int")).alias("recall"), F.min("at").alias("first_rank"))
    per = cases.select("query_id").join(per, "query_id")
    return per.select("query_id", "recall", F.col("first_rank").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), "first_rank")


def suite(scores: DataFrame, *by: str) -> DataFrame:
    """Macro means of case scores, for each group if any are named."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("hit").alias("hit_rate"), F.avg("reciprocal_rank").alias("mrr"))


def latency(times: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, sum, mean, nearest-rank median and 95th percentile, and maximum."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return times.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max(value).alias("largest"))


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, before, after, delta) over the names of either run; a metric that a run lacks is 0."""
    both = a.select("metric", F.col("value").alias("x")).join(b.select("metric", F.col("value").alias("y")), "metric", "full")
    return both.select("metric", F.coalesce("x", F.lit(0.0)).alias("before"), F.coalesce("y", F.lit(0.0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def regressions(compared: DataFrame, tolerance: float) -> DataFrame:
    """Adds regressed: a metric fell by more than the tolerance, beyond what rounding explains."""
    fell = (F.col("delta") < -tolerance) & (F.abs(F.col("delta") + tolerance) > 1e-12)
    return compared.withColumn("regressed", fell)


def parity(rows: DataFrame, identity: list[str], native: str, foreign: str, floor: float = 0.85) -> DataFrame:
    """Each arm's foreign recall over its native one, and whether it reaches the floor; null where native is 0."""
    wide = rows.groupBy(*identity).pivot("language", [native, foreign]).agg(F.avg("recall"))
    ratio = F.try_divide(F.col(foreign), F.col(native))
    return wide.select(*identity, F.col(native).alias("native"), F.col(foreign).alias("foreign"), ratio.alias("ratio"), (ratio >= floor - 1e-12).alias("passes"))


def latest(rows: DataFrame, by: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each group."""
    order = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in newest])
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def candidate_coverage(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: cases, those without any candidate, their share, and candidates a case."""
    counted = cases.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("n") == 0).alias("empty"), (F.count_if(F.col("n") == 0) / F.count(F.lit(1))).alias("empty_rate"), F.avg("n").alias("mean_candidates"))
