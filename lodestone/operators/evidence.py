"""Evidence for an answer: repeated texts, slots and budgets with what they cost, grades, and reasons for an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import prefer_documents, text_owner

#: What an array of entries takes beside them.
ENVELOPE = 2


def entry_chars(*columns: str) -> Column:
    """What a hit takes in the prompt: its columns as JSON, keys in order, and a comma."""
    return (F.length(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})) + 1).cast("long")


def distinct_texts(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits whose text no better one of the query has; and (query_id, doc_id, owner) of the others."""
    told = text_owner(hits)
    return told.where("owner = doc_id").drop("owner"), told.where("owner <> doc_id").select("query_id", "doc_id", "owner")


def _filled(hits: DataFrame, order: str, k: int, budget: int, name: str) -> DataFrame:
    """(query_id, {name: taken and dropped ids}): hits in order until k are taken; those that don't fit the budget are dropped,
    those after the k-th aren't looked at. A query's hits are the few that retrieval gave it."""
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, "chunk_id", "cost"))).alias("hits"))
    ids = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(max(0, budget - ENVELOPE)).cast("long").alias("left"), ids.alias("taken"), ids.alias("dropped"))

    def step(acc: Column, hit: Column) -> Column:
        open_ = F.size(acc["taken"]) < k
        fits = open_ & (hit["cost"] <= acc["left"])
        more = lambda which, when: F.when(when, F.concat(acc[which], F.array(hit["chunk_id"].cast("long")))).otherwise(acc[which])
        left = acc["left"] - F.when(fits, hit["cost"].cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(left.alias("left"), more("taken", fits).alias("taken"), more("dropped", open_ & ~fits).alias("dropped"))

    return listed.select("query_id", F.aggregate("hits", zero, step, lambda acc: F.struct(acc["taken"].alias("taken"), acc["dropped"].alias("dropped"))).alias(name))


def selected(hits: DataFrame, k: int, per_document: int, budget: int) -> DataFrame:
    """(query_id, selected, over_quota, over_budget): ids in the order in which they were taken or lost.

    hits: (query_id, doc_id, chunk_id, rank, cost). Each document's first `per_document` hits come before all others. Over the
    quota are those that ranks alone would have taken; over the budget those that had a slot and didn't fit.
    """
    by_rank = _filled(hits, "rank", k, budget, "natural")
    preferred = _filled(prefer_documents(hits, per_document), "place", k, budget, "chosen")
    both = preferred.join(by_rank, "query_id")
    return both.select("query_id", F.col("chosen.taken").alias("selected"), F.array_except("natural.taken", "chosen.taken").alias("over_quota"), F.col("chosen.dropped").alias("over_budget"))


def graded(evidence: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, relevant, unknown, missing, below): evidence found relevant, in its order; grades of what was not supplied;
    evidence without a grade; and whether nothing is relevant.

    evidence: (query_id, ids), grades: (query_id, chunk_id, relevant). A query without grades has all its evidence missing.
    """
    told = grades.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("told"), F.collect_set(F.when(F.col("relevant"), F.col("chunk_id"))).alias("good"))
    none = F.array().cast("array<bigint>")
    both = evidence.join(told, "query_id", "left").select("query_id", "ids", F.coalesce("told", none).alias("told"), F.coalesce("good", none).alias("good"))
    out = both.select("query_id", F.array_intersect("ids", "good").alias("relevant"), F.array_except("told", "ids").alias("unknown"), F.array_except("ids", "told").alias("missing"))
    return out.withColumn("below", F.size("relevant") == 0)


def absence(stages: DataFrame) -> DataFrame:
    """Adds reason: the first stage at which a question lost its evidence, null where it has an answer.

    stages: (retrieved, selected, relevant, cited), counts of what each stage left; a null counts as none.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return stages.withColumn("reason", F.when(none("retrieved"), "nothing was found").when(none("selected"), "nothing fitted").when(none("relevant"), "nothing was relevant").when(none("cited"), "nothing was cited"))


def candidates(k: int, stated: int | None = None) -> int:
    """How many hits to fetch for k: four times as many and 20 at least, or what was stated, if that is enough."""
    if k <= 0 or (stated is not None and stated < k):
        raise ValueError(f"k {k}, candidates {stated}")
    return max(20, 4 * k) if stated is None else stated
