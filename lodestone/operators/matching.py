"""Which documents a web search meets: operands of a table of queries against the places of lexemes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lodestone.functions.query import websearch_tokens
from lodestone.functions.stemming import lexeme_spots

from .ranking import having

#: Texts and bytes of an Arrow batch, at most; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


@F.pandas_udf(ArrayType(StructType([StructField("excluded", BooleanType()), StructField("text", StringType())])))
def _operands(queries: pd.Series) -> pd.Series:
    def told(query: str | None) -> list[tuple[bool, str]]:
        parts = [t for t in websearch_tokens(query or "") if t.lower() != "or"]
        return [(len(t) > 1 and t.startswith("-"), t.removeprefix("-").replace('"', " ") if len(t) > 1 else t) for t in parts]

    return queries.map(told)


def operands(queries: DataFrame) -> DataFrame:
    """(query_id, operand, excluded, korean, n, nth, lexeme): the lexemes of each operand of each web search, by either plan.

    queries: (query_id, query). Operands are words and quoted phrases; `or` is none, and a dash before one excludes it. n is how
    many lexemes an operand has, nth how far behind its first one a lexeme stands; an operand without a lexeme gives no row.
    """
    parts = queries.select("query_id", F.posexplode_outer(_operands("query")).alias("operand", "o")).where("o IS NOT NULL")
    spots = parts.select("query_id", "operand", "o.excluded", *(lexeme_spots(F.col("o.text"), F.lit(c)).alias(c) for c in ("en", "ko")))
    named = lambda c: F.transform(c, lambda s: F.struct(F.lit(c == "ko").alias("korean"), F.size(c).alias("n"), (s["at"] - F.col(c)[0]["at"]).alias("nth"), s["lexeme"].alias("lexeme")))
    # an inner explode would put a filter below the functions, which would then run twice
    told = spots.select("query_id", "operand", "excluded", F.explode_outer(F.concat(named("en"), named("ko"))).alias("t")).where("t IS NOT NULL")
    return told.select("query_id", "operand", "excluded", "t.korean", "t.n", "t.nth", "t.lexeme")


def positions(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, korean, lexeme, at): where each lexeme of a document stands, by the plan of its language."""
    # whole texts: a worker holds the lexemes of so many at once. Spark reads the settings when the result is run, so they stay
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    told = documents.select(*keys, F.col("language").eqNullSafe("ko").alias("korean"), lexeme_spots(F.col(text), F.col("language")).alias("spots"))
    return told.select(*keys, "korean", F.explode_outer("spots").alias("s")).where("s IS NOT NULL").select(*keys, "korean", "s.lexeme", "s.at")


def relaxed(queries: DataFrame, documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(query_id, keys) of the documents that have any positive operand of a query and none that it excludes.

    documents: (keys, language, text). A document's language says by which plan a query is read for it. A phrase, and a word that
    falls into several lexemes, is met where its lexemes stand as far apart as in the query, stop words counted. A query without
    a positive lexeme meets nothing; null texts have no lexemes. Only places of asked lexemes are moved.
    """
    asked = operands(queries)
    places = positions(documents, keys, text)
    hits = having(places, asked).join(asked, ["korean", "lexeme"])
    whole = hits.groupBy("query_id", "operand", "excluded", *keys, (F.col("at") - F.col("nth")).alias("begin"), "n").agg(F.count(F.lit(1)).alias("met")).where("met = n")
    told = whole.groupBy("query_id", *keys).agg(F.bool_or("excluded").alias("out"))
    return told.where("NOT out").select("query_id", *keys)
