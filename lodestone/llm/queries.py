"""The queries of this package's operators over whole tables, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, manifest, mixing, near_dedup, packing, quality, resampling, secrets, token_counts, toxicity, vector_dedup
from . import exact_dedup as exact
from .common import remainder

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(df: DataFrame, n: int, rest: int) -> DataFrame:
    """Adds held_out: whether crc32 of the id modulo n is `rest`."""
    return df.withColumn("held_out", remainder("doc_id", n) == rest)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = remainder("doc_id", 5)
    model = toxicity.train(docs, labels, learn=fold.isin(1, 2, 3), tune=fold == 4)
    return held_out(toxicity.score(docs, model), 5, 0).select("doc_id", "held_out", "score", "predicted", "toxic_ll", "ordinary_ll")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    trees = quality.train(docs, labels, learn=remainder("doc_id", 3) != 1)
    return held_out(quality.classify(docs, trees), 3, 1).select("doc_id", "held_out", "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_gone").cast("long").alias("n_gone"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = manifest.leaf([*own, F.translate("text", ascii_uppercase, ascii_lowercase)])
    claim = F.when(remainder("doc_id", 5) == 0, tampered).otherwise(manifest.leaf([*own, F.col("text")]))
    return manifest.digest(manifest.manifest(read(spark, sf_dir, "documents"), claim=claim))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_mixing, op4_secrets, op5_near_dedup, op6_vector_dedup, op7_exact_dedup, op8_quality, op9_line_dedup, op10_bpe, op11_packing, op12_manifest, op13_resampling)}

#: crc32 in DuckDB's SQL: its table of 256 entries from the polynomial, and a fold over the bytes of a text.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t"


def crc_sql(text: str, t: str = "t") -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, with CRC_TABLE's list in a column t."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex({text}), {at}, 1)) - 1)"
    codes = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: 16 * {digit('i')} + {digit('i + 1')})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, x: xor({t}[(xor(c, x) & 255) + 1], c >> 8)))"


ORACLE: dict[str, str] = {
    "op3_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('7:' || coalesce(doc_id::VARCHAR, '')) AS stamp
            FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap
            FROM sources),
        levels AS (
            SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER before, 0)) AS level
            FROM ranked
            WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        shares AS (
            SELECT source, source_size,
                   CASE WHEN level * weight >= cap THEN cap
                        ELSE weight * (SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight < cap) END AS target
            FROM levels),
        whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM shares),
        ordered AS (
            SELECT s.doc_id, s.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS goal,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.stamp, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source)
        SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before + size / 2 <= goal THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM ordered""",
    "op4_secrets": secrets.oracle(),
    "op5_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)""",
    "op6_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
        least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)""",
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op12_manifest": f"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        typed AS (SELECT doc_id, source, lang, n_chars, text, translate(text, '{ascii_uppercase}', '{ascii_lowercase}') AS low, {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 AS changed FROM documents, crc),
        hashed AS (
            SELECT doc_id, source, changed, sha256(concat({", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))})) AS leaf,
                   sha256(concat({", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "low"))})) AS low_leaf FROM typed),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
        tree AS (
            SELECT 0 AS level, source, pos, leaf AS node FROM leaves
            UNION ALL
            SELECT any_value(level) + 1, source, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, max(pos) OVER (PARTITION BY source) AS last FROM tree) WHERE last > 0 GROUP BY source, pos // 16),
        subroots AS (SELECT source, arg_max(node, level) AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree GROUP BY source),
        top AS (
            SELECT 0 AS level, place AS pos, subroot AS node FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, max(pos) OVER () AS last FROM top) WHERE last > 0 GROUP BY pos // 16),
        runs AS (SELECT level, source, pos // 16 AS up, string_agg(node, '' ORDER BY pos) AS run FROM (SELECT *, max(pos) OVER (PARTITION BY level, source) AS last FROM tree) WHERE last > 0 GROUP BY level, source, up),
        top_runs AS (SELECT level, pos // 16 AS up, string_agg(node, '' ORDER BY pos) AS run FROM (SELECT *, max(pos) OVER (PARTITION BY level) AS last FROM top) WHERE last > 0 GROUP BY level, up),
        steps AS (
            SELECT l.source, l.pos, r.level, r.run, (l.pos // (16 ** r.level)::BIGINT) % 16 AS own FROM leaves l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND r.up = l.pos // (16 ** (r.level + 1))::BIGINT
            UNION ALL
            SELECT l.source, l.pos, 100 + r.level, r.run, (s.place // (16 ** r.level)::BIGINT) % 16 FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN top_runs r ON r.up = s.place // (16 ** (r.level + 1))::BIGINT),
        proofs AS (
            SELECT source, pos, list(run[:64 * own] || '|' || run[64 * own + 65:] ORDER BY level) AS sides FROM steps GROUP BY source, pos),
        folded AS (
            SELECT l.doc_id, l.leaf, s.subroot, (SELECT arg_max(node, level) FROM top) AS root, coalesce(p.sides, []) AS sides, CASE WHEN l.changed THEN l.low_leaf ELSE l.leaf END AS claim
            FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN proofs p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(sides, ''), '|', '')) AS proof_sha256,
               list_reduce(list_concat([claim], sides), lambda f, x: sha256(split_part(x, '|', 1) || f || split_part(x, '|', 2))) AS folded_root,
               folded_root = root AS verified
        FROM folded""",
    "op13_resampling": rf"""
        WITH crc AS ({CRC_TABLE}),
        texts AS (SELECT doc_id, text, false AS target FROM documents UNION ALL SELECT item_id, text, true FROM benchmark),
        w AS (SELECT doc_id, target, coalesce(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
        f AS (
            SELECT doc_id, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
        n AS (SELECT doc_id, target, f, count(*) AS n FROM f GROUP BY ALL),
        dictionary AS (SELECT f, {crc_sql("f", "crc.t")} % 10000 AS bucket, s, counts.t AS t FROM (SELECT f, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM n GROUP BY f) counts, crc),
        totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM dictionary),
        buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM dictionary GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM buckets, totals),
        sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM n JOIN dictionary USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id),
        scored AS (
            SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
                   coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
                   ('0x' || sha256('7:' || w.doc_id)[:8])::BIGINT AS h
            FROM w LEFT JOIN sums USING (doc_id) WHERE NOT target),
        ranked AS (
            SELECT doc_id, n_words, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM scored),
        placed AS (
            SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
                   count(*) FILTER (n_words >= 20) OVER () AS eligible FROM ranked)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * eligible // 100 THEN place END AS rank FROM placed""",
}
