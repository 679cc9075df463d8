"""A corpus pipeline: stages of the training-data operators, each of which works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, line_dedup, mixing, near_dedup, quality
from lodestone.llm.common import filter_of, hits, may_have, new_path, remainder, remove, scratch, stored, table
from lodestone.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it learns from the labels of two folds of three.

    Null texts are judged as empty ones. Rows with null or repeated ids are judged each by their texts. Without rows or
    without labels the model is a constant; other columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accept(docs, quality.train(docs, labels, learn=remainder("doc_id", 3) != 1))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that occur before; a document that loses all it says goes. n_chars follows the text.

    Null texts count as empty and stay as empty texts, as they lose no line. Of equal lines the one in the row with the
    smallest id stays, null ids being last; rows that share id and text share one decision. Other columns pass through.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = line_dedup.line_dedup(docs, carry=others).where((F.col("n_gone") == 0) | (F.btrim("text", F.lit(" \n\t\r\x0b\f")) != ""))
    kind = dict(docs.dtypes).get("n_chars", "long")
    told = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(kind).alias("n_chars")}
    return out.select(*[told.get(c, F.col("carried").getField(c).alias(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Null, empty and blank texts are no duplicates of anything, and rows without an id stay. Rows that share an id are one
    document: all stay or go. Other columns pass through.
    """
    gone = table(near_dedup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone-ids", thin=True)
    wanted = filter_of(gone.select(F.xxhash64("gone").alias("key")), "key", "gone-id-filter")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.xxhash64(F.col("doc_id").cast("long")), F.lit(0).cast("long")).alias("key"))
    # most texts are told from those that go by a bounded broadcast, and aren't shuffled
    sure = rows.join(wanted, hits(F.col("key")), "left_anti")
    rest = may_have(rows, "key", wanted).join(gone, F.col("id") == F.col("gone"), "left_anti")
    return sure.unionByName(rest).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the sources' target weights ask for.

    Null texts have no words, and null sources are one source; documents without words are taken as often as all of their
    source are. Rows that share id and source are repeated alike. Ties in the seeded order go by id. Other columns pass through.
    """
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether decoding gives its text again: a row for each row, in any order.

    Null texts count as empty and have no ids; null and repeated ids pass through; other columns don't.
    """
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", accept_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: A classifier and signatures are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result but the last is written to the shared folder and read again. Once it
    stands, the stage's own tables and the result before it are removed, so that the disk holds one stage at a time."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
