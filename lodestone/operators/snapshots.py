"""Frozen corpora: what a snapshot holds, whether it still stands, and which chunks and vectors go or stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells one embedding of a chunk from another: its text's hash and the model it came from.
IDENTITY = ["chunk_id", "sha256", "provider", "model", "dimensions", "tokenizer"]


def same_model(provider: str, model: str, dimensions: int, tokenizer: str) -> Column:
    """Whether a row's vector was made by this model."""
    wanted = {"provider": provider, "model": model, "dimensions": dimensions, "tokenizer": tokenizer}
    return F.forall(F.array(*[F.col(c).eqNullSafe(F.lit(v)) for c, v in wanted.items()]), lambda x: x)


def freeze(chunks: DataFrame, vectors: DataFrame, snapshot_id: int, model: dict) -> DataFrame:
    """All chunks under a snapshot's number, each with its vector by this model or null.

    chunks: (chunk_id, sha256, ...), vectors: IDENTITY and embedding. A vector of another text or model is not taken.
    """
    mine = vectors.where(same_model(**model)).groupBy("chunk_id", "sha256").agg(F.any_value("embedding").alias("embedding"))
    return chunks.join(mine, ["chunk_id", "sha256"], "left").select(F.lit(snapshot_id).alias("snapshot_id"), *chunks.columns, "embedding")


def require_same(recorded: str, found: str) -> None:
    """A snapshot is made only of the index whose fingerprint was recorded."""
    if recorded != found:
        raise ValueError("the index changed since its fingerprint was recorded")


def restricted(chunks: DataFrame, members: DataFrame, snapshot_id: int) -> DataFrame:
    """Chunks that a snapshot holds."""
    return chunks.join(members.where(F.col("snapshot_id") == snapshot_id).select("chunk_id"), "chunk_id", "left_semi")


def current_members(snapshots: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """(snapshot_id, members, current) of every snapshot: its documents, and those whose source is still the same."""
    now = documents.select("doc_id", F.col("sha256").alias("now")).distinct()
    both = snapshots.select("snapshot_id").join(members.select("snapshot_id", "doc_id", "sha256"), "snapshot_id", "left").join(now, "doc_id", "left")
    return both.groupBy("snapshot_id").agg(F.count("doc_id").alias("members"), F.count_if(F.col("now") == F.col("sha256")).alias("current"))


def outside(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence (doc_id, sha256, ...) that no member of the snapshot backs."""
    return evidence.join(members.select("doc_id", "sha256").distinct(), ["doc_id", "sha256"], "left_anti")


def cleaned(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    """Chunks without those that a batch no longer has: of the batch's documents only what it names stays, others are left alone."""
    kept = chunks.join(batch.select("doc_id", "stable_key").distinct(), ["doc_id", "stable_key"], "left_semi")
    return kept.unionByName(chunks.join(batch.select("doc_id").distinct(), "doc_id", "left_anti"))


def stored(vectors: DataFrame, new: DataFrame, chunks: DataFrame) -> DataFrame:
    """vectors and those new ones whose chunk still has the text that was embedded, and that aren't there yet.

    Of several new ones with one identity, any one is taken.
    """
    valid = new.join(chunks.select("chunk_id", "sha256").distinct(), ["chunk_id", "sha256"], "left_semi").join(vectors.select(IDENTITY).distinct(), IDENTITY, "left_anti")
    rest = [c for c in vectors.columns if c not in IDENTITY]
    one = valid.groupBy(*IDENTITY).agg(F.any_value(F.struct(*rest)).alias("x")).select(*IDENTITY, "x.*")
    return vectors.unionByName(one.select(vectors.columns))


def fragments(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, fragment) of the wanted chunks that have a fragment, each once."""
    return chunks.where(F.col("fragment").isNotNull()).join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "fragment")
