"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: The filter has at most 2 to this power bits: 2**20 words of 64 bits, some 32 MB as a broadcast relation.
MAX_BITS_LOG2 = 26


def _slots(sha: Column, bits_log2: int) -> list[Column]:
    """Two independent bit positions of a digest."""
    mask = F.lit((1 << bits_log2) - 1).cast("long")
    return [F.xxhash64(sha, F.lit(seed)).bitwiseAND(mask) for seed in (1, 2)]


def _bit(slot: Column) -> Column:
    """The bit of a slot within its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_log2: int | None = None) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts the row with the largest id stays.
    Pass one counts which bits of a Bloom filter are set by two rows or more and keeps those bits; pass two probes it, and
    only rows whose bits are all set (possibly repeated texts) shuffle by digest. A filter that is too small for the input
    lets more rows through to the shuffle; results stay exact. The filter's bits are 16 for each row, up to
    2**MAX_BITS_LOG2, which bounds the broadcast.

    Null ids lose against any other id; a group of null ids only has a null keep_id and its rows are kept. Rows that repeat
    an id and a text count each in group_size and share `kept`. Other columns are ignored; an empty table gives no rows.
    """
    rows = table(df.select(F.col(id_col).alias("doc_id"), F.sha2(text_of(text_col).cast("binary"), 256).alias("text_sha256")), "digests")
    if bits_log2 is None:
        bits_log2 = min(MAX_BITS_LOG2, max(16, (16 * rows.count()).bit_length()))
    slots = rows.select(F.explode(F.array_distinct(F.array(*_slots(F.col("text_sha256"), bits_log2)))).alias("slot"))
    repeated = slots.groupBy("slot").count().where("count > 1")
    words = table(repeated.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(_bit(F.col("slot"))).alias("bits")), "bloom")
    probed = rows
    for k, slot in enumerate(_slots(F.col("text_sha256"), bits_log2)):
        probed = probed.withColumn(f"slot{k}", slot)
        hit = words.select(F.col("word").alias(f"word{k}"), F.col("bits").alias(f"bits{k}"))
        probed = probed.join(F.broadcast(hit), F.shiftright(f"slot{k}", 6) == F.col(f"word{k}"), "left")
    maybe = F.lit(True)
    for k in range(2):
        maybe = maybe & (F.coalesce(F.col(f"bits{k}"), F.lit(0).cast("long")).bitwiseAND(_bit(F.col(f"slot{k}"))) != 0)
    probed = probed.select("doc_id", "text_sha256", maybe.alias("maybe"))
    suspects = probed.where("maybe").drop("maybe")
    groups = table(suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    told = suspects.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    alone = probed.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return told.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
