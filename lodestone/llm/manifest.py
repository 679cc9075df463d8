"""A Merkle manifest of a dataset: DuckDB hashes aligned buckets of nodes on the executors, Spark combines buckets and proofs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, table

#: Nodes of a run, and levels that a bucket of FAN**LEVELS nodes spans.
FAN, LEVELS = 16, 3
BUCKET = FAN**LEVELS
#: Rows that DuckDB gets at once, or one bucket if that is more, and rows of a batch of proofs.
CHUNK, OUT = 8192, 1024
#: Digits of a digest.
HEX = 64


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and itself, or `-` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def _levels(size: Column) -> Column:
    """The levels to be hashed in a bucket of a group of so many nodes: as many as there are until one node remains."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(size <= FAN**k, k).otherwise(out)
    return out


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "preserve_insertion_order": True})


def _runs() -> str:
    """SQL's tables of a chunk's levels: l0 holds the nodes, lk each run of level k with its digest."""
    out = [f"l0 AS (SELECT bucket, rank % {BUCKET} AS pos, levels, node FROM nodes WHERE rank >= 0)"]
    for k in range(1, LEVELS + 1):
        told = f"SELECT bucket, pos // {FAN} AS up, any_value(levels) AS levels, string_agg(node, '' ORDER BY pos) AS run FROM l{k - 1} WHERE levels >= {k} GROUP BY bucket, up"
        out.append(f"l{k} AS (SELECT bucket, up AS pos, levels, run, sha256(run) AS node FROM ({told}))")
    return ", ".join(out)


ROOTS = f"""
    WITH {_runs()}, roots AS ({" UNION ALL ".join(f"SELECT bucket, node FROM l{k} WHERE levels = {k}" for k in range(LEVELS + 1))})
    SELECT grp, block AS rank, (size + {BUCKET - 1}) // {BUCKET} AS size, roots.node AS node FROM roots JOIN nodes USING (bucket) WHERE head"""

#: For each node of a chunk its siblings before and after it in its runs, then those of its bucket.
SIBLINGS = f"""
    WITH {_runs()},
    outer_rows AS (SELECT bucket, befores, afters, subroot, root FROM nodes WHERE head)
    SELECT n.*, o.subroot, o.root, {", ".join(f"substr(l{k}.run, 1, {HEX} * (n.rank // {FAN ** (k - 1)} % {FAN})) AS b{k}, substr(l{k}.run, {HEX} * (n.rank // {FAN ** (k - 1)} % {FAN}) + {HEX + 1}) AS a{k}" for k in range(1, LEVELS + 1))},
        o.befores AS outer_befores, o.afters AS outer_afters
    FROM (SELECT * EXCLUDE (befores, afters, subroot, root) FROM nodes WHERE rank >= 0) n JOIN outer_rows o ON n.bucket = o.bucket
    {" ".join(f"LEFT JOIN l{k} ON l{k}.bucket = n.bucket AND l{k}.pos = n.rank % {BUCKET} // {FAN**k}" for k in range(1, LEVELS + 1))}"""

#: A node's siblings level by level, those of its bucket after its own.
SIDES = [f"list_filter([{', '.join(f'{side[0]}{k}' for k in range(1, LEVELS + 1))}], lambda x: x IS NOT NULL) || outer_{side} AS {side}" for side in ("befores", "afters")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets, which `head` rows begin, some CHUNK rows at once, with a number for each bucket."""
    held: list[pa.RecordBatch] = []
    n = 0

    def told(rows: pa.Table) -> pa.Table:
        return rows.append_column("bucket", pa.array(np.cumsum(rows.column("head").to_numpy(zero_copy_only=False)), pa.int64()))

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            rows = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(rows.column("head").to_numpy(zero_copy_only=False))[-1])
            if cut:
                yield told(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            n -= cut
    if n:
        yield told(pa.Table.from_batches(held))


def _asked(sql: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _engine() as engine:
            for nodes in _chunks(batches):
                engine.register("nodes", nodes)
                yield from engine.execute(f"SELECT {', '.join(names)} FROM ({sql})").to_arrow_table().to_batches(max_chunksize=OUT)
                engine.unregister("nodes")

    return run


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf's proof, and its claim folded with it to the root."""
    with _engine() as engine:
        for nodes in _chunks(batches):
            engine.register("nodes", nodes)
            deepest = engine.execute("SELECT coalesce(max(len(befores)), 0) FROM nodes WHERE head").fetchone()[0]
            steps = [f"CASE WHEN b{k} IS NULL THEN {{f}} ELSE sha256(b{k} || {{f}} || a{k}) END" for k in range(1, LEVELS + 1)]
            steps += [f"CASE WHEN len(outer_befores) < {i} THEN {{f}} ELSE sha256(outer_befores[{i}] || {{f}} || outer_afters[{i}]) END" for i in range(1, deepest + 1)]
            sql = f"SELECT *, claim AS f0 FROM ({SIBLINGS})"
            for k, step in enumerate(steps):
                sql = f"SELECT *, {step.format(f=f'f{k}')} AS f{k + 1} FROM ({sql})"
            inner = ", ".join(f"b{k}, a{k}" for k in range(1, LEVELS + 1))
            outer = "array_to_string(list_transform(outer_befores, lambda x, i: x || outer_afters[i]), '')"
            sql = f"SELECT id, node AS leaf, subroot, root, concat({inner}, {outer}) AS proof, f{len(steps)} AS folded_root FROM ({sql})"
            yield from engine.execute(sql).to_arrow_table().to_batches(max_chunksize=OUT)
            engine.unregister("nodes")


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes by bucket, each bucket whole and in order; one bucket is BUCKET rows at most, whatever its group holds."""
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank")


def _placed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / BUCKET)).withColumn("levels", _levels(F.col("size")))


def _tiers(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The nodes (grp, rank, size, node), their buckets' roots, and so on until each group has one node."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("size")).first()[0] or 1) > 1:
        headed = _dealt(_placed(tiers[-1]).withColumn("head", F.col("rank") % BUCKET == 0).select("grp", "block", "rank", "size", "levels", "node", "head"))
        tiers.append(table(headed.mapInArrow(_asked(ROOTS, ["grp", "rank", "size", "node"]), "grp string, rank long, size long, node string"), label, thin=True))
    return tiers


def _with_outer(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes with their buckets' outer siblings in a row before them: outer is keyed by (grp, rank), the bucket's number."""
    before = outer.select("grp", F.col("rank").alias("block"), F.lit(-1).cast("long").alias("rank"), F.lit(True).alias("head"), "befores", "afters", "subroot", "root")
    return _dealt(_placed(nodes).withColumn("head", F.lit(False)).unionByName(before, allowMissingColumns=True))


def _down(tiers: list[DataFrame], outer: DataFrame, label: str) -> DataFrame:
    """Siblings of the nodes of all tiers but the first, from those of the last: (grp, rank, befores, afters, subroot, root) of
    the first tier's buckets."""
    for nodes in reversed(tiers[1:-1]):
        told = _with_outer(nodes.select("grp", "rank", "size", "node"), outer).select("grp", "block", "rank", "levels", "node", "head", "befores", "afters", "subroot", "root")
        schema = "grp string, rank long, befores array<string>, afters array<string>, subroot string, root string"
        outer = table(told.mapInArrow(_asked(SIBLINGS, ["grp", "rank", *SIDES, "subroot", "root"]), schema), label, thin=True)
    return outer


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claim: Column | None = None) -> DataFrame:
    """One row for each row of df: id, leaf, subroot, root, proof, folded_root, verified.

    A leaf is a row's digest. Within a group leaves ascend by id, and every FAN consecutive nodes become one until one is left,
    the subroot; subroots, ordered by group, likewise give the root. `proof` holds a leaf's siblings, left to right, level by
    level from the leaf to the root. `claim` is the digest that a row is said to have, by default its leaf: folded with the
    proof it gives folded_root, which equals the root exactly if the claim is the leaf.

    Leaves are numbered by ranges, so a hot group is dealt to many tasks. Buckets of BUCKET consecutive nodes are hashed by
    DuckDB where they are; only their roots go on, a BUCKET-th of the rows, until each group has one node. Proofs of inner
    nodes come down the same way, and those of leaves are made last and only read, never stored.

    Null groups are one group, before all others; null ids come first in a group. Rows that repeat an id are leaves of their
    own, in order of their digests. Null fields differ from empty ones. The id is returned as `id`; other columns are ignored;
    an empty table gives no rows.
    """
    own = leaf([F.col(c) for c in fields])
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), own.alias("node"), (own if claim is None else F.coalesce(claim, own)).alias("claim"))
    leaves = numbered(rows, [F.col("id").asc_nulls_first(), F.col("node"), F.col("claim")], "grp", "leaves")
    tiers = _tiers(leaves, "roots")
    subroots = tiers[-1].select(F.col("grp").alias("of"), "node", F.lit("").alias("grp"))
    upper = numbered(subroots, [F.col("of").asc_nulls_first()], label="subroots")
    tops = _tiers(upper, "tops")
    none = F.array().cast("array<string>")
    # the root has no siblings; then come the subroots' siblings, then those of each group's inner nodes
    top = tops[-1].select("grp", F.lit(0).cast("long").alias("rank"), none.alias("befores"), none.alias("afters"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    outer = _down(tops, top, "top-siblings")
    below = _with_outer(upper.select("grp", "of", "rank", "size", "node"), outer).select("grp", "of", "block", "rank", "levels", "node", "head", "befores", "afters", "subroot", "root")
    told = below.mapInArrow(_asked(SIBLINGS, ["of AS grp", *SIDES, "node AS subroot", "root"]), "grp string, befores array<string>, afters array<string>, subroot string, root string")
    outer = table(told.withColumn("rank", F.lit(0).cast("long")), "subroot-siblings", thin=True)
    outer = _down(tiers, outer, "siblings")
    last = _with_outer(leaves.select("id", "grp", "rank", "size", "node", "claim"), outer)
    kind = dict(rows.dtypes)["id"]
    proofs = last.select("id", "grp", "block", "rank", "levels", "node", "claim", "head", "befores", "afters", "subroot", "root").mapInArrow(_folds, f"id {kind}, leaf string, subroot string, root string, proof string, folded_root string")
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(rows: DataFrame) -> DataFrame:
    """A manifest's rows with the digest of each proof in its place."""
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
