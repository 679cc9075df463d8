"""Catalog: filters, document counts, facets, coverage grids, merges of source lists, and paging."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Exact-match filters; an empty tuple restricts nothing. Values are sorted and distinct, so equal filters are equal."""

    doc_ids: tuple[int, ...] = ()
    languages: tuple[str, ...] = ()
    issuers: tuple[str, ...] = ()
    fiscal_years: tuple[int, ...] = ()
    forms: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name, values in vars(self).items():
            object.__setattr__(self, name, tuple(sorted(set(values))))

    def predicate(self) -> Column:
        column = {"doc_ids": "doc_id", "languages": "language", "issuers": "issuer", "fiscal_years": "fiscal_year", "forms": "form"}
        out = F.lit(True)
        for name, values in vars(self).items():
            if values:
                out = out & F.col(column[name]).isin(list(values))
        return out

    @property
    def needs_documents(self) -> bool:
        """Whether a search over chunks has to join documents at all."""
        return any(v for k, v in vars(self).items() if k not in ("doc_ids", "languages"))


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks) of every document, those without chunks too."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"))


def coverage(chunks: DataFrame, done: Column, by: str = "doc_id") -> DataFrame:
    """(by, chunks, embedded, share, status): complete, partial or missing, by how many of the chunks are done."""
    out = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(done).alias("embedded"))
    status = F.when(F.col("embedded") == F.col("chunks"), "complete").when(F.col("embedded") > 0, "partial").otherwise("missing")
    return out.withColumn("share", F.try_divide("embedded", "chunks")).withColumn("status", status)


def facets(documents: DataFrame, dimensions: list[str]) -> DataFrame:
    """(facet, value, n): counts by each dimension, in one pass over grouping sets."""
    rows = documents.select(F.explode(F.array(*[F.struct(F.lit(d).alias("facet"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x"))
    return rows.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def single_label(rows: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label): the only value a group has, or null if it has several."""
    return rows.groupBy(by).agg(F.when(F.count_distinct(label) == 1, F.min(label)).alias(label))


def target_grid(rows: DataFrame, x: str, y: str, targets: list[int], want: int) -> DataFrame:
    """(x, y, n, short): every pair of an x that occurs and a target y, with its rows and how many are short of `want`."""
    grid = rows.select(x).distinct().select(x, F.explode(F.array(*map(F.lit, targets))).alias(y))
    n = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("short", F.greatest(F.lit(want) - F.col("n"), F.lit(0)).cast("long"))


def merge_sources(old: DataFrame, found: DataFrame, identity: list[str], id_col: str) -> DataFrame:
    """Existing rows win; of the others the one with the smallest id joins for each identity."""
    new = found.join(old.select(identity).distinct(), identity, "left_anti")
    first = new.groupBy(*identity).agg(F.min(id_col).alias(id_col))
    return old.select(*identity, id_col).unionByName(first)


def exactly_one(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value) of groups of one row; any other count raises when it is read."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.when(n == 1, F.min(value)).otherwise(F.raise_error(F.concat(F.lit("rows in a group: "), n.cast("string")))).alias(value))


def unanimous(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): a value that all rows of the group have, else null."""
    return rows.groupBy(by).agg(F.when((F.count_distinct(value) == 1) & (F.count(value) == F.count(F.lit(1))), F.min(value)).alias(value))


def page(rows: DataFrame, order: list[Column], size: int, cursor: str | None = None) -> tuple[DataFrame, str]:
    """A page of rows behind an opaque cursor, and the next page's cursor."""
    at = int(base64.urlsafe_b64decode(cursor)) if cursor else 0
    return rows.orderBy(*order).offset(at).limit(size), base64.urlsafe_b64encode(str(at + size).encode()).decode()


def after(rows: DataFrame, key: str, last: int, size: int) -> DataFrame:
    """The next rows by key, and one more that tells whether there are others."""
    return rows.where(F.col(key) > last).orderBy(key).limit(size + 1)


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each rule; a rule that is null is broken."""
    return rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def schema_drift(rows: DataFrame, expected: list[str]) -> list[str]:
    """Columns that are expected and missing; extra ones are tolerated."""
    return [c for c in expected if c not in rows.columns]
