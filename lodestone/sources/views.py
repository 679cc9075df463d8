"""The domain's relations, as views over plain tables: documents, line chunks, postings, gold spans, ledgers and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import passages
from lodestone.functions.text import tokens


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, with its language, issuer, fiscal year, form and the identity of its source."""
    d = read(spark, path, "documents")
    return d.select(
        "doc_id",
        F.col("lang").alias("language"),
        F.col("source").alias("issuer"),
        (2019 + F.col("doc_id") % 6).cast("int").alias("fiscal_year"),
        F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.col("doc_id") % 3 + 1).cast("int")).alias("form"),
        F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"),
        F.length("text").cast("long").alias("n_chars"),
        "text",
    )


def chunks(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """One chunk a line that isn't blank: (doc_id, line_no, start_char, end_char, body, language), spans half-open in code points.

    The offset of a line is what the lines before it take, which a fold over the text's own lines gives without a shuffle.
    only: a few (doc_id) whose documents alone are read.
    """
    d = read(spark, path, "documents")
    d = d if only is None else d.join(F.broadcast(only.select("doc_id").distinct()), "doc_id", "left_semi")
    d = d.select("doc_id", F.col("lang").alias("language"), F.split("text", "\n").alias("lines"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<line_no:int,start_char:bigint,body:string>>").alias("out"))

    def step(acc, line):
        span = F.struct(F.size(acc["out"]).alias("line_no"), acc["at"].alias("start_char"), line.alias("body"))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = d.select("doc_id", "language", F.explode(F.aggregate("lines", begin, step, lambda acc: acc["out"])).alias("x"))
    out = spans.select("doc_id", "language", "x.line_no", "x.start_char", (F.col("x.start_char") + F.length("x.body")).alias("end_char"), "x.body")
    return out.where(F.trim("body") != "")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, language, lexeme, tf): how often each document has each token."""
    d = read(spark, path, "documents")
    t = d.select("doc_id", F.col("lang").alias("language"), F.explode(tokens(F.col("text"))).alias("lexeme"))
    return t.groupBy("doc_id", "language", "lexeme").agg(F.count(F.lit(1)).alias("tf"))


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, language, dl) of documents with a token, without a shuffle of their tokens."""
    d = read(spark, path, "documents").select("doc_id", F.col("lang").alias("language"), F.size(tokens(F.col("text"))).cast("long").alias("dl"))
    return d.where("dl > 0").groupBy("doc_id", "language").agg(F.sum("dl").alias("dl"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, doc_id, start_char, end_char): where a document holds a benchmark passage word for word.

    The passages are a stated query set, held against all texts in one pass.
    """
    d, b = read(spark, path, "documents"), read(spark, path, "benchmark")
    return passages.found(d, b.select("item_id", F.col("text").alias("passage")))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question): the stated query set, from the benchmark's passages."""
    return read(spark, path, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
