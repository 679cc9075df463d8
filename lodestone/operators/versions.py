"""Versions of small relations such as golden suites: content-addressed tables, and a head that moves only from the version that a
writer has seen."""

from __future__ import annotations

import hashlib
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(ValueError):
    """The head is not the version that the writer had read, or another writer moved it first."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def row_text(columns: list[str]) -> Column:
    """A row as JSON, its columns in order of name, nulls kept, so that equal rows have equal texts."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_hash(df: DataFrame, fan: int = 4096) -> str:
    """The SHA-256 of the rows, the same in any order; repeated rows count.

    Equal rows are counted first, so copies are one entry. Entries are grouped by so many first digits of their digests that a group
    holds some `fan` of them, then sixteen groups make one, until one is left.
    """
    each = df.select(F.sha2(row_text(df.columns).cast("binary"), 256).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    entries = each.select("d", F.concat_ws(":", "d", F.col("n").cast("string")).alias("e"))
    count, digits = entries.count(), 0
    while count > fan * 16**digits:
        digits += 1
    level = entries.select(F.substring("d", 1, digits).alias("p"), "e")
    for k in range(digits, -1, -1):
        level = level.groupBy(F.substring("p", 1, k).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("e")), ",").cast("binary"), 256).alias("e"))
    first = level.first()
    return first.e if first else hashlib.sha256().hexdigest()


def _heads(spark: SparkSession, root: str, name: str) -> list[tuple[int, str]]:
    """(number, hash) of each move of the head; the hash is empty where a writer died before it had told it."""
    where, fs = _path(spark, f"{root}/{name}/heads")
    numbers = sorted(int(x.getPath().getName()) for x in (fs.listStatus(where) if fs.exists(where) else []) if x.getPath().getName().isdigit())
    out = []
    for n in numbers:
        file = fs.open(_path(spark, f"{root}/{name}/heads/{n}")[0])
        told = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        file.close()
        out.append((n, told if re.fullmatch("[0-9a-f]{64}", told) else ""))
    return out


def head(spark: SparkSession, root: str, name: str) -> str | None:
    """The hash of the newest version; none before the first."""
    return next((told for _, told in reversed(_heads(spark, root, name)) if told), None)


def read(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A version's rows, by default the newest one's. A version never changes, so what is read stays what was read."""
    version = version or head(spark, root, name)
    if version is None:
        raise ValueError(f"{name} has no version")
    return spark.read.parquet(f"{root}/{name}/versions/{version}")


def commit(df: DataFrame, root: str, name: str, expected: str | None) -> str:
    """Writes rows as a version and moves the head to it if the head is still `expected`; returns the version's hash.

    The table is written beside its place and renamed, so it is whole or not there; rows that a version has already are not written
    again. The head moves by creating the next number's file, which a store with atomic creation (HDFS, conditional puts) lets one
    writer do; a writer that finds it there has lost and gets Conflict, as does one whose `expected` is not the head. A number whose
    writer died before telling its version counts for nothing. A table that a lost writer has left is a version that no head names.
    """
    spark = df.sparkSession
    heads = _heads(spark, root, name)
    found = next((told for _, told in reversed(heads) if told), None)
    if found != expected:
        raise Conflict(f"{name} is at {found}, not at {expected}")
    version = content_hash(df)
    place, fs = _path(spark, f"{root}/{name}/versions/{version}")
    if not fs.exists(place):
        beside = f"{root}/{name}/versions/.{uuid.uuid4().hex}"
        df.write.parquet(beside)
        if not fs.rename(_path(spark, beside)[0], place):
            fs.delete(_path(spark, beside)[0], True)
    if version == found:
        return version
    file = _path(spark, f"{root}/{name}/heads/{heads[-1][0] + 1 if heads else 1}")[0]
    try:
        out = fs.create(file, False)
    except Py4JJavaError as e:
        raise Conflict(f"another writer moved {name} from {expected}") from e
    out.writeBytes(version)
    out.close()
    return version
