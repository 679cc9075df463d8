"""Golden suites and their runs: twins, bindings, provenance, baselines, comparisons by category, combined gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import HANGUL, collapse

from .evaluation import suite

#: The order of arms.
STRATEGIES = ["lexical", "vector", "hybrid"]
RANKERS = ["ts_rank_cd", "bm25"]


def twins(first: DataFrame, second: DataFrame, invariant: list[str], key: str = "case_id") -> DataFrame:
    """(key, problem) of the cases of two suites that must say the same in two languages; problem is null where all is well.

    A case that one suite lacks or repeats, a column of `invariant` that differs, a question that both suites share but for case
    and white space, Hangul in a question of the first suite, and none in one of the second are problems; the first of them is
    named. A suite without cases is a problem too, told in a row without a key.
    """
    empty = [df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast(dict(df.dtypes)[key]).alias(key), F.lit(f"{x} suite is empty").alias("problem")) for df, x in ((first, "first"), (second, "second"))]
    folded = F.lower(collapse(F.col("question")))
    side = lambda df, x: df.withColumn("folded", folded).groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{x}"), *[F.min(c).alias(f"{c}_{x}") for c in [*invariant, "folded"]])
    both = side(first, "a").join(side(second, "b"), key, "full")
    problem = F.when(F.col("n_a").isNull(), "first suite lacks it").when(F.col("n_b").isNull(), "second suite lacks it").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated")
    for c in invariant:
        problem = problem.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), c)
    problem = problem.when(F.col("folded_a").eqNullSafe(F.col("folded_b")), "one question")
    problem = problem.when(F.col("folded_a").rlike(HANGUL), "Hangul in the first suite").when(~F.coalesce(F.col("folded_b").rlike(HANGUL), F.lit(False)), "no Hangul in the second suite")
    return both.select(key, problem.alias("problem")).union(empty[0]).union(empty[1])


def bound(needed: DataFrame, documents: DataFrame, identity: list[str]) -> DataFrame:
    """(golden_id, doc_id, state) of needed filings: ready where exactly one document has the identity, else source_missing or
    source_invalid, with a null doc_id. Documents are counted by identity first, so an ambiguous one makes one row."""
    found = documents.groupBy(*identity).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    state = F.when(F.col("n").isNull(), "source_missing").when(F.col("n") > 1, "source_invalid").otherwise("ready")
    both = needed.join(found, identity, "left").withColumn("state", state)
    return both.select("golden_id", F.when(F.col("state") == "ready", F.col("doc_id")).alias("doc_id"), "state")


def verified_spans(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds problem to answers (doc_id, sha256, start_char, end_char): the source is missing or other, the span leaves the text,
    or nothing of it can be seen. sources: (doc_id, sha256, text)."""
    s = sources.select("doc_id", F.col("sha256").alias("found"), "text")
    both = answers.join(s, "doc_id", "left")
    inside = (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.length("text"))
    seen = collapse(F.substring("text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")))
    problem = F.when(F.col("found").isNull(), "no source").when(F.col("found") != F.col("sha256"), "other source").when(~inside, "outside").when(seen == "", "blank")
    return both.withColumn("problem", problem).drop("found", "text")


def provenance(cases: DataFrame, *by: str) -> DataFrame:
    """(cases, positive, absent, status), for each group if any are named. A suite of several statuses, or without any case
    that has answers, raises when it is read."""
    status = F.when(F.count_distinct(F.coalesce("status", F.lit(""))) == 1, F.min("status")).otherwise(F.raise_error(F.lit("several statuses in a suite")))
    some = F.count_if(F.col("answers") > 0)
    positive = F.when(some > 0, some).otherwise(F.raise_error(F.lit("no case with answers")).cast("bigint"))
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), positive.alias("positive"), F.count_if(~(F.coalesce("answers", F.lit(0)) > 0)).alias("absent"), status.alias("status"))


def baseline(runs: DataFrame, by: list[str], newest: list[str], same: Column, among: int = 100) -> DataFrame:
    """Each group's newest run that is `same`, among its last `among`; groups without one give no row."""
    order = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in newest])
    last = runs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= among)
    return last.where(same).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def category_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, before, after, delta): mean recall by category of two arms' case scores, of categories that both have."""
    a, b = (suite(df, "category").select("category", F.col("recall").alias(x)) for df, x in ((before, "before"), (after, "after")))
    return a.join(b, "category").withColumn("delta", F.col("after") - F.col("before"))


def gate(arms: DataFrame, require_baseline: bool = False, *by: str) -> DataFrame:
    """(parity, regression, first_runs, passed): one verdict over arms (parity, regression: both boolean, regression null for a
    first run). Without any comparison the verdict's regression is null, which doesn't fail it; parity that is null does."""
    told = arms.groupBy(*by).agg(F.bool_and(F.coalesce("parity", F.lit(False))).alias("parity"), F.bool_and("regression").alias("regression"), F.count_if(F.col("regression").isNull()).alias("first_runs"))
    known = (F.col("first_runs") == 0) | F.lit(not require_baseline)
    return told.withColumn("passed", F.col("parity") & F.coalesce("regression", F.lit(True)) & known)


def arm_order(arms: DataFrame) -> DataFrame:
    """Adds place: arms by target, strategy, ranker (none first) and name. An experiment's arms are a few rows."""
    at = lambda c, of: F.array_position(F.array(*map(F.lit, of)), F.coalesce(c, F.lit("")))
    order = Window.orderBy("target", at(F.col("strategy"), STRATEGIES), at(F.col("ranker"), RANKERS), "name")
    return arms.withColumn("place", F.row_number().over(order))


def found_cases(cases: DataFrame, needle: str, sort: str, offset: int, limit: int) -> DataFrame:
    """A page of the cases whose id or question holds the needle, whatever the letters' case."""
    if offset < 0 or not 1 <= limit <= 100 or len(needle) > 200:
        raise ValueError(f"offset {offset}, limit {limit}, needle of {len(needle)}")
    text = F.lower(F.concat_ws(" ", F.col("case_id").cast("string"), "question"))
    return cases.where(F.contains(text, F.lit(needle.strip().lower()))).orderBy(F.lower(F.col(sort).cast("string")), "case_id").offset(offset).limit(limit)
