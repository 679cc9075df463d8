"""Identities: canonical JSON, digests, deterministic vectors, signed tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import math
import re
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose values are hidden in nested JSON.
SENSITIVE = re.compile(r"(?i)(api[_-]?key|token|secret|password|authorization)")


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, UTF-8 as it is; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _canonical(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str | None:
        try:
            return canonical_json(json.loads(text))
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def canonical(text: Column | str) -> Column:
    """JSON text in canonical form; null for what is no JSON."""
    return F.pandas_udf(_canonical, "string")(text)


def sanitize(value: object) -> object:
    """A JSON value without secrets: values of sensitive keys are hidden; keys that fall together are an error."""
    if isinstance(value, dict):
        out = {str(k).strip(): "[REDACTED]" if SENSITIVE.search(str(k)) else sanitize(v) for k, v in value.items()}
        if len(out) != len(value):
            raise ValueError("keys fall together")
        return out
    return [sanitize(v) for v in value] if isinstance(value, list) else value


def rows_digest(rows: DataFrame, text: str) -> DataFrame:
    """One row: the digest of all rows' texts, in any order. Digests of digests by their first byte keep groups bounded."""
    each = rows.select(F.sha2(F.col(text).cast("binary"), 256).alias("d"))
    parts = each.groupBy(F.substring("d", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ",").cast("binary"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ",").cast("binary"), 256).alias("digest"))


def hashed_vector(rows: DataFrame, key: str, words: Column, dimensions: int) -> DataFrame:
    """(key, embedding): each word adds one or takes one at a place, both from its SHA-256; the sum has length one.

    The place is the digest's first 8 bytes modulo the dimensions, the sign the lowest bit of the ninth. Texts without words,
    or whose words cancel, point along the first axis.
    """
    w = rows.select(key, F.explode_outer(words).alias("w")).withColumn("d", F.sha2(F.col("w").cast("binary"), 256))
    place = (F.conv(F.substring("d", 1, 16), 16, 10).cast("decimal(20,0)") % dimensions).cast("int")
    sign = F.when(F.conv(F.substring("d", 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = w.groupBy(key, place.alias("place")).agg(F.sum(sign).alias("v"))
    listed = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull() & (F.col("v") != 0), F.struct("place", "v")))).alias("m"), F.sqrt(F.sum(F.when(F.col("place").isNotNull(), F.col("v") * F.col("v")).otherwise(0.0))).alias("norm"))
    unit = F.when(F.col("norm") > 0, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0.0)) / F.col("norm")))
    first = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    return listed.select(key, F.coalesce(unit, first).alias("embedding"))


def reference_vector(words: list[str], dimensions: int) -> list[float]:
    """The same on the driver."""
    out = [0.0] * dimensions
    for w in words:
        d = hashlib.sha256(w.encode()).digest()
        out[int.from_bytes(d[:8]) % dimensions] += 1.0 if d[8] % 2 == 0 else -1.0
    norm = math.sqrt(sum(v * v for v in out))
    return [v / norm for v in out] if norm else [1.0] + [0.0] * (dimensions - 1)


def sign(payload: dict, key: bytes, seconds: int, now: float | None = None) -> str:
    """A token that holds the payload for so many seconds."""
    body = canonical_json(payload | {"until": int((now or time.time()) + seconds)}).encode()
    return ".".join(base64.urlsafe_b64encode(x).rstrip(b"=").decode() for x in (body, hmac.digest(key, body, "sha256")))


def verify(token: str, key: bytes, now: float | None = None) -> dict:
    """The payload of a token that is whole and not too old; else an error."""
    try:
        body, mac = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in token.split("."))
    except ValueError as e:
        raise ValueError("no token") from e
    if not hmac.compare_digest(mac, hmac.digest(key, body, "sha256")):
        raise ValueError("wrong signature")
    payload = json.loads(body)
    if payload.pop("until") < (now or time.time()):
        raise ValueError("too old")
    return payload
