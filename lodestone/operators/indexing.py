"""Index tables as ordinary DataFrames: postings, lengths, document frequencies, corpus statistics, fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.stemming import lexeme_counts
from lodestone.streaming.streams import shared_folder


def lengths(postings: DataFrame) -> DataFrame:
    """(doc_id, language, dl): a document's length in tokens."""
    return postings.groupBy("doc_id", "language").agg(F.sum("tf").alias("dl"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(language, lexeme, df)."""
    return postings.groupBy("language", "lexeme").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(postings: DataFrame) -> DataFrame:
    """(language, n, avgdl) over documents with a token."""
    return statistics(lengths(postings))


def statistics(lengths: DataFrame) -> DataFrame:
    """(language, n, avgdl) of documents' lengths."""
    return lengths.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def receipt(postings: DataFrame) -> DataFrame:
    """One row: how many postings, lengths and frequencies an index has."""
    return postings.agg(F.count(F.lit(1)).alias("n_terms"), F.count_distinct("doc_id").alias("n_lengths"), F.count_distinct("language", "lexeme").alias("n_lexemes"))


def fingerprint(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, fingerprint): a digest of each key's rows in order of their text, the same for the same rows in any order."""
    row = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ",").cast("binary"), 256).alias("fingerprint"))


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose identity is not among the done ones: what a resumable backfill still has to do."""
    return rows.join(done.select(keys).distinct(), keys, "left_anti")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: new rows, and old ones whose key no new row has."""
    return new.unionByName(old.join(new.select(keys).distinct(), keys, "left_anti"))


def forward(chunks: DataFrame, keys: list[str], text: str = "body", path: str | None = None) -> DataFrame:
    """An index written once: (keys, language, dl, terms), a row for each chunk, terms being its lexemes with their counts.

    A text is read once, by its language's plan, and nothing is shuffled; postings, lengths, frequencies and statistics all
    come from the table, which is written to `path`, or to a folder of its own in the shared folder. Chunks without a lexeme
    have none and a length of 0. Null texts have no lexemes; null languages are read as English and count as a language.
    """
    spark = chunks.sparkSession
    told = chunks.select(*keys, "language", lexeme_counts(F.col(text), F.col("language")).alias("terms"))
    path = path or f"{shared_folder(spark)}/index_{uuid.uuid4().hex}"
    told.write.parquet(path)
    dl = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + t["tf"])
    return spark.read.schema(told.schema).parquet(path).select(*keys, "language", dl.alias("dl"), "terms")


def postings_of(index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, language, dl, lexeme, tf) of a written index."""
    return index.select(*keys, "language", "dl", F.explode("terms").alias("t")).select(*keys, "language", "dl", "t.lexeme", "t.tf")


def readiness(chunks: DataFrame, index: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row: n_chunks, n_indexed, n_missing, n_stale, n_orphans, ready.

    chunks and index: (keys, version, ...). An index is ready if it holds each chunk in its own version and nothing else. Keys and
    versions are joined, no texts; an index table is written once and never changed, so what is read here is what is searched.
    """
    want = chunks.select(*keys, F.col(version).alias("wanted"), F.lit(True).alias("in_chunks"))
    have = index.select(*keys, F.col(version).alias("held"), F.lit(True).alias("in_index"))
    both = want.join(have, keys, "full")
    told = both.agg(
        F.count("in_chunks").alias("n_chunks"), F.count("in_index").alias("n_indexed"), F.count_if(F.col("in_index").isNull()).alias("n_missing"),
        F.count_if(F.col("in_index") & F.col("in_chunks") & ~F.col("wanted").eqNullSafe(F.col("held"))).alias("n_stale"), F.count_if(F.col("in_chunks").isNull()).alias("n_orphans"),
    )
    return told.withColumn("ready", (F.col("n_chunks") > 0) & (F.col("n_missing") == 0) & (F.col("n_stale") == 0) & (F.col("n_orphans") == 0))
