"""The catalog's back office: search, addresses that may be shown, job lists, previews, and the state of sources."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import redact

#: Names of this machine, and addresses that no public network routes: this network, private use, this machine,
#: link-local, protocol assignments, documentation, benchmarks, the former class E; of the long form also mapped addresses.
LOCAL = ["localhost", "host.docker.internal", "ollama", "host.containers.internal"]
PRIVATE = (
    r"^(?=\d{1,3}(?:\.\d{1,3}){3}$)(?:0|10|127|169\.254|172\.(?:1[6-9]|2\d|3[01])|192\.0\.[02]|192\.168|198\.1[89]|198\.51\.100|203\.0\.113|24\d|25[0-5])\."
    r"|^\[?(?:::1?\]?$|::ffff:|64:ff9b:1:|100::|2001:db8:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
)


def holds(needle: str, *columns: str) -> Column:
    """Whether any column has the needle, whatever the letters' case; blank around it is dropped, an empty one is everywhere."""
    wanted, out = needle.strip().lower(), F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted)), F.lit(False))
    return out if wanted else F.lit(True)


def none_match(rows: DataFrame, predicate: Column) -> bool:
    """Whether a scope is empty; stops at the first row that isn't."""
    return rows.where(predicate).isEmpty()


def public_url(url: Column) -> Column:
    """The address if it is one of the web, names a host, and holds neither credentials nor secrets; else an empty text."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    ok = part("PROTOCOL").isin("http", "https") & (F.coalesce(part("HOST"), F.lit("")) != "") & part("USERINFO").isNull() & (redact(url) == url)
    return F.when(F.coalesce(ok, F.lit(False)), url).otherwise("")


def provider(url: Column) -> Column:
    """(provider, local) of a recorded address: what kind of service it is, and whether it runs on this machine or network."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    hosted = F.when(F.contains(path, F.lit("embedding")), "openai_embeddings").otherwise("openai_responses")
    other = F.when(F.contains(path, F.lit("/v1/")), "openai_compatible").otherwise("external_api")
    kind = (
        F.when(scheme == "deterministic", "deterministic")
        .when(scheme == "local", F.when(host == "ollama", "ollama").otherwise("openai_compatible"))
        .when(host == "api.openai.com", hosted)
        .when(F.contains(path, F.lit("/api/")) & path.rlike("chat|generate|embed"), "ollama")
        .when(host != "", other)
        .otherwise("unknown")
    )
    near = F.when(scheme.isin("local", "deterministic"), True).when(host != "", host.isin(LOCAL) | host.rlike(PRIVATE))
    return F.struct(kind.alias("provider"), near.alias("local"))


def newest_jobs(jobs: DataFrame, limit: int = 100, archived: bool = False) -> DataFrame:
    """The newest jobs (job_id, created, status, archived): those put away only if asked for, or while they are under way."""
    shown = jobs if archived else jobs.where(~F.coalesce("archived", F.lit(False)) | F.col("status").isin("queued", "running"))
    return shown.orderBy(F.col("created").desc(), F.col("job_id").desc()).limit(limit)


def preview(chunks: DataFrame, n: int, chars: int) -> DataFrame:
    """(doc_id, ordinal, body): each document's first n chunks, their first so many characters."""
    first = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n).select("doc_id", "ordinal", F.substring("body", 1, chars).alias("body"))


def section_counts(chunks: DataFrame, vectors: DataFrame, model: list[str]) -> DataFrame:
    """(section, model columns, n, embedded): chunks by section and by the model of their vector; nulls where there is none.

    Sums by section and sums by model both follow from these few rows.
    """
    of = vectors.select("chunk_id", *model, F.lit(1).alias("has"))
    both = chunks.select("chunk_id", F.coalesce("section", F.lit("unsectioned")).alias("section")).join(of, "chunk_id", "left")
    return both.groupBy("section", *model).agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("embedded"))


def ingestion_status(documents: DataFrame, manifest: DataFrame, identity: list[str]) -> DataFrame:
    """(doc_id, status): current where the manifest's row has the same identity, stale where another, unknown where none."""
    m = manifest.select("doc_id", F.struct(*identity).alias("wanted"))
    same = F.struct(*identity).eqNullSafe(F.col("wanted"))
    return documents.join(m, "doc_id", "left").select("doc_id", F.when(F.col("wanted").isNull(), "unknown").when(same, "current").otherwise("stale").alias("status"))


def source_states(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(doc_id, state) of every document by its artifacts (doc_id, role, sha256, archive_sha256): ready with one primary and at
    most one archive that the primary names, missing without a primary, else ambiguous or unlinked."""
    role = lambda r: F.col("role") == r
    held = artifacts.where(F.col("role").isin("primary", "archive")).groupBy("doc_id").agg(
        F.count_if(role("primary")).alias("primaries"), F.count_if(role("archive")).alias("archives"),
        F.max(F.when(role("primary"), F.col("archive_sha256"))).alias("named"), F.max(F.when(role("archive"), F.col("sha256"))).alias("archive"),
    )
    several = (F.col("primaries") > 1) | (F.col("archives") > 1)
    state = F.when(several, "ambiguous").when(F.coalesce("primaries", F.lit(0)) == 0, "missing").when((F.col("archives") == 1) & ~F.col("named").eqNullSafe(F.col("archive")), "unlinked").otherwise("ready")
    return documents.select("doc_id").join(held, "doc_id", "left").select("doc_id", state.alias("state"))


def issuers_of(codes: DataFrame, listing: DataFrame) -> DataFrame:
    """(code, issuer): the first issuer that the listing (code, at, issuer) has for each code; a code it lacks raises when read."""
    first = listing.groupBy("code").agg(F.min_by("issuer", "at").alias("issuer"), F.lit(1).alias("listed")).join(codes.select("code").distinct(), "code", "right")
    lacks = F.raise_error(F.concat(F.lit("no issuer for "), F.col("code").cast("string")))
    return first.select("code", F.when(F.col("listed").isNotNull(), F.col("issuer")).otherwise(lacks).alias("issuer"))


def allowance(runs: DataFrame, limits: dict[str, list[str]]) -> DataFrame:
    """Adds left_{what} for each what: the least of its limits that is given, less what is used (used_{what}); never below 0,
    null where no limit is given."""
    out = runs
    for what, columns in limits.items():
        least = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
        left = least - F.coalesce(F.col(f"used_{what}"), F.lit(0))
        out = out.withColumn(f"left_{what}", F.when(least.isNotNull(), F.greatest(left, F.lit(0).cast("long"))))
    return out


def artifact_name(at: datetime, arm: str) -> str:
    """The file name of an arm's record: its UTC time and its name, which is lower-case words joined by hyphens."""
    if at.tzinfo is None or not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", arm):
        raise ValueError(f"{at}, {arm!r}")
    return f"{at.astimezone(UTC):%Y%m%dT%H%M%SZ}-{arm}.json"
