"""Files: manifests, verified bytes, archives, strict JSON, snapshots."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "artifact_id string, path string, sha256 string, byte_length long, role string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of a manifest (a JSON document with a list `artifacts`); repeated ids or paths are an error."""
    rows = spark.read.schema(f"artifacts array<struct<{', '.join(x.replace(' ', ': ', 1) for x in MANIFEST.split(', '))}>>").json(path, multiLine=True).select(F.inline("artifacts"))
    for c in ("artifact_id", "path"):
        if twice := rows.groupBy(c).count().where("count > 1").select(c).take(5):
            raise ValueError(f"repeated {c}: {[r[0] for r in twice]}")
    return rows


def verified(spark: SparkSession, artifacts: DataFrame, root: str) -> DataFrame:
    """Adds content and ok: whether a file under root has the length and digest that the manifest says."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.regexp_replace("path", rf"^.*?{root.strip('/')}/", "").alias("path"), "content")
    same = (F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("byte_length"))
    return artifacts.join(files, "path", "left").withColumn("ok", F.coalesce(same, F.lit(False)))


def decoded(files: DataFrame, encodings: tuple[str, ...] = ("utf-8", "euc-kr", "cp949")) -> DataFrame:
    """Adds text: content in the first encoding that fits without replacing anything; null if none does."""

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        def one(content: bytes) -> str | None:
            for e in encodings:
                try:
                    return bytes(content).decode(e)
                except (UnicodeDecodeError, TypeError):
                    continue
            return None

        return contents.map(one)

    return files.withColumn("text", text("content"))


def members(files: DataFrame, suffix: str = ".xml") -> DataFrame:
    """(path, name, content) of archives' members with this suffix; what is no archive has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(path, n, z.read(n)) for n in sorted(z.namelist()) if n.endswith(suffix)]
            yield pd.DataFrame(out, columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def strict_json(text: str, most: int = 1 << 24) -> object:
    """A JSON value; repeated keys, NaN and texts that are too long are errors."""
    if len(text) > most:
        raise ValueError("too long")

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def never(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=pairs, parse_constant=never)


def snapshot(rows: DataFrame, path: str, snapshot_id: str) -> None:
    """Freezes rows under an id; an id is written once."""
    rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("error").parquet(f"{path}/snapshot_id={snapshot_id}")


def flatten(pages: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from parallel arrays."""
    return pages.select(F.inline(F.arrays_zip(*columns)))
