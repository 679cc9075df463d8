"""Queries of suites, snapshots, evidence and the catalog's back office, over plain tables that stand in for theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import admin, chunking, evidence, snapshots, suites
from lodestone.sources import views

from .more_queries import ORACLE, QUERIES
from .queries import BM25, CHUNK, DOCUMENT, FILLED, LUCENE, bm25_hits, listed, query

__all__ = ["ORACLE", "QUERIES"]

# --- suites --------------------------------------------------------------------------------------------------------

SIDES = "a AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT * FROM lineitem WHERE l_linestatus = 'O')"


def sides(spark, d):
    rows = views.read(spark, d, "lineitem")
    return rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'")


@query("""
    WITH a AS (SELECT s_suppkey AS case_id, s_nationkey AS nation, CASE WHEN s_suppkey % 3 = 0 THEN '왜 ' || s_name WHEN s_suppkey % 7 = 0 THEN s_suppkey::VARCHAR ELSE s_name END AS question FROM supplier),
    b AS (SELECT p_partkey AS case_id, p_partkey % 25 AS nation, CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_partkey WHEN p_partkey % 2 = 0 THEN '매출 ' || p_name ELSE p_name END AS question FROM part)
    SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'first suite lacks it' WHEN b.case_id IS NULL THEN 'second suite lacks it'
        WHEN a.nation IS DISTINCT FROM b.nation THEN 'nation' WHEN lower(trim(a.question)) = lower(trim(b.question)) THEN 'one question'
        WHEN regexp_matches(a.question, '[가-힣]') THEN 'Hangul in the first suite' WHEN NOT regexp_matches(b.question, '[가-힣]') THEN 'no Hangul in the second suite' END AS problem
    FROM a FULL JOIN b USING (case_id)""")
def ref_twins(spark, d):
    key, part = F.col("s_suppkey"), F.col("p_partkey")
    a = views.read(spark, d, "supplier").select(key.alias("case_id"), F.col("s_nationkey").alias("nation"), F.when(key % 3 == 0, F.concat(F.lit("왜 "), "s_name")).when(key % 7 == 0, key.cast("string")).otherwise(F.col("s_name")).alias("question"))
    b = views.read(spark, d, "part").select(part.alias("case_id"), (part % 25).alias("nation"), F.when(part % 7 == 0, F.concat(F.lit(" "), part.cast("string"))).when(part % 2 == 0, F.concat(F.lit("매출 "), "p_name")).otherwise(F.col("p_name")).alias("question"))
    return suites.twins(a, b, ["nation"])


@query("""
    WITH f AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS doc_id FROM customer GROUP BY ALL)
    SELECT o_orderkey AS golden_id, CASE WHEN n = 1 THEN doc_id END AS doc_id, CASE WHEN n IS NULL THEN 'source_missing' WHEN n > 1 THEN 'source_invalid' ELSE 'ready' END AS state
    FROM orders LEFT JOIN f ON c_nationkey = o_orderkey % 25 AND c_mktsegment = ['BUILDING', 'FURNITURE', 'MACHINERY', 'NOWHERE'][o_custkey % 4 + 1]""")
def ref_golden_binding(spark, d):
    segment = "element_at(array('BUILDING', 'FURNITURE', 'MACHINERY', 'NOWHERE'), CAST(o_custkey % 4 + 1 AS INT)) AS segment"
    needed = views.read(spark, d, "orders").selectExpr("o_orderkey AS golden_id", "o_orderkey % 25 AS nation", segment)
    documents = views.read(spark, d, "customer").selectExpr("c_custkey AS doc_id", "c_nationkey AS nation", "c_mktsegment AS segment")
    return suites.bound(needed, documents, ["nation", "segment"])


@query("""
    WITH s AS (SELECT doc_id, length(text) AS n, text FROM documents),
    a AS (SELECT doc_id, doc_id % 7 AS w, n_chars - 20 AS s, n_chars + doc_id % 3 - 1 AS e FROM documents UNION ALL SELECT doc_id + 1000000000, 1, 0, 1 FROM documents WHERE lang = 'de')
    SELECT a.doc_id, s AS start_char, e AS end_char, CASE WHEN n IS NULL THEN 'no source' WHEN w = 0 THEN 'other source' WHEN NOT (s >= 0 AND s < e AND e <= n) THEN 'outside'
        WHEN trim(regexp_replace(text[s + 1:e], '\\s+', ' ', 'g')) = '' THEN 'blank' END AS problem FROM a LEFT JOIN s USING (doc_id)""".replace("\\\\", "\\"))
def ref_verified_spans(spark, d):
    rows = views.read(spark, d, "documents")
    sources = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "text")
    sha = F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    held = rows.select("doc_id", sha.alias("sha256"), (F.col("n_chars") - 20).alias("start_char"), (F.col("n_chars") + F.col("doc_id") % 3 - 1).alias("end_char"))
    lost = rows.where("lang = 'de'").selectExpr("doc_id + 1000000000 AS doc_id", "'' AS sha256", "0L AS start_char", "1L AS end_char")
    return suites.verified_spans(held.unionByName(lost), sources).drop("sha256")


@query("SELECT o_orderstatus AS suite, count(*) AS cases, count(*) FILTER (o_custkey % 5 > 0) AS positive, count(*) FILTER (o_custkey % 5 = 0) AS absent, o_orderstatus AS status FROM orders GROUP BY ALL")
def ref_golden_provenance(spark, d):
    cases = views.read(spark, d, "orders").select(F.col("o_orderstatus").alias("suite"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 5).alias("answers"))
    return suites.provenance(cases, "suite")


@query("""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT event_type, event_id FROM l WHERE n <= 100 AND json_extract_string(props, '$.k')::INT % 10 = 7 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n) = 1""")
def ref_baseline_run(spark, d):
    same = F.get_json_object("props", "$.k").cast("int") % 10 == 7
    return suites.baseline(views.read(spark, d, "events"), ["event_type"], ["ts", "event_id"], same).select("event_type", "event_id")


@query(f"""
    WITH {SIDES}, x AS (SELECT l_returnflag AS category, avg(l_discount) AS v FROM a GROUP BY ALL), y AS (SELECT l_returnflag AS category, avg(l_discount) AS v FROM b GROUP BY ALL)
    SELECT category, round(x.v, 9) AS before, round(y.v, 9) AS after, round(y.v - x.v, 9) AS delta FROM x JOIN y USING (category)""")
def ref_category_deltas(spark, d):
    scores = lambda rows: rows.select(F.col("l_returnflag").alias("category"), F.col("l_discount").alias("recall"), F.lit(1).alias("hit"), F.lit(1.0).alias("reciprocal_rank"))
    a, b = sides(spark, d)
    return suites.category_deltas(scores(a), scores(b)).select("category", *[F.round(c, 9).alias(c) for c in ("before", "after", "delta")])


@query("""
    WITH g AS (SELECT o_custkey AS suite, bool_and(o_totalprice > 5000) AS parity, bool_and(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority <> '1-URGENT' END) AS regression, count(*) FILTER (o_orderstatus = 'P') AS first_runs FROM orders GROUP BY ALL)
    SELECT *, parity AND coalesce(regression, true) AND first_runs = 0 AS passed FROM g""")
def ref_gate_verdict(spark, d):
    compared = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "1-URGENT")
    arms = views.read(spark, d, "orders").select(F.col("o_custkey").alias("suite"), (F.col("o_totalprice") > 5000).alias("parity"), compared.alias("regression"))
    return suites.gate(arms, True, "suite")


@query("SELECT c_custkey AS case_id, c_name AS question FROM customer WHERE contains(lower(c_custkey || ' ' || c_name), '#00000001') ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 3")
def ref_find_cases(spark, d):
    cases = views.read(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("question"))
    return suites.found_cases(cases, " #00000001 ", "question", 3, 20)


# --- snapshots -----------------------------------------------------------------------------------------------------

MODEL = {"provider": "p", "model": "m", "dimensions": 8, "tokenizer": "t"}


def frozen_chunks(spark, d):
    return views.read(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("sha256"), F.col("o_custkey").alias("doc_id"))


def frozen_vectors(spark, d):
    """Vectors of two models; some are of other texts than their chunks have now."""
    o = views.read(spark, d, "orders").where("o_orderstatus <> 'P'")
    old = F.when(F.col("o_orderkey") % 5 == 0, F.lit("old")).otherwise(F.col("o_orderpriority"))
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("m")).otherwise(F.lit("n"))
    return o.select(F.col("o_orderkey").alias("chunk_id"), old.alias("sha256"), F.lit("p").alias("provider"), kind.alias("model"), F.lit(8).alias("dimensions"), F.lit("t").alias("tokenizer"), F.col("o_totalprice").alias("embedding"))


@query("SELECT 7 AS snapshot_id, o_orderkey AS chunk_id, o_custkey AS doc_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN o_totalprice END AS embedding FROM orders")
def ref_freeze(spark, d):
    return snapshots.freeze(frozen_chunks(spark, d), frozen_vectors(spark, d), 7, MODEL).select("snapshot_id", "chunk_id", "doc_id", "embedding")


@query("SELECT c_custkey AS chunk_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def ref_snapshot_scope(spark, d):
    members = views.read(spark, d, "orders").select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderstatus").alias("snapshot_id"))
    return snapshots.restricted(views.read(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), "c_name"), members, "P")


@query("SELECT n_nationkey AS snapshot_id, count(c_custkey) AS members, count(*) FILTER (o_orderpriority = '1-URGENT') AS current FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY ALL) ON o_custkey = c_custkey GROUP BY ALL")
def ref_snapshot_members(spark, d):
    members = views.read(spark, d, "customer").select(F.col("c_nationkey").alias("snapshot_id"), F.col("c_custkey").alias("doc_id"), F.lit("1-URGENT").alias("sha256"))
    documents = views.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max("o_orderpriority").alias("sha256"))
    return snapshots.current_members(views.read(spark, d, "nation").select(F.col("n_nationkey").alias("snapshot_id")), members, documents)


@query("SELECT l_orderkey AS doc_id, l_linenumber FROM lineitem WHERE (l_orderkey, l_returnflag) NOT IN (SELECT (o_orderkey, ['A', 'N', 'R'][o_custkey % 3 + 1]) FROM orders)")
def ref_outside_snapshot(spark, d):
    flag = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_custkey") % 3 + 1).cast("int"))
    members = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), flag.alias("sha256"))
    held = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("sha256"), "l_linenumber")
    return snapshots.outside(held, members).drop("sha256")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS stable_key, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' OR (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_linestatus = 'F')")
def ref_stale_chunks(spark, d):
    o = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    rows = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("stable_key"), "l_quantity", "l_linestatus").join(o, "doc_id")
    # documents of which a batch names no chunk lose all of theirs
    batch = o.where("o_orderstatus = 'F'").join(rows.where("l_linestatus = 'F'").select("doc_id", "stable_key"), "doc_id", "left").select("doc_id", "stable_key")
    return snapshots.cleaned(rows, batch).select("doc_id", "stable_key", "l_quantity")


@query("SELECT o_orderkey AS chunk_id, CASE WHEN o_orderstatus = 'F' THEN 'm' ELSE 'n' END AS model, o_totalprice AS embedding FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 5 <> 0)")
def ref_conditional_store(spark, d):
    v = frozen_vectors(spark, d)
    return snapshots.stored(v.where("model = 'm'"), v, frozen_chunks(spark, d)).select("chunk_id", "model", "embedding")


@query("SELECT p_partkey AS chunk_id, p_type AS fragment FROM part WHERE p_type <> 'ECONOMY' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def ref_fragments(spark, d):
    chunks = views.read(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.nullif("p_type", F.lit("ECONOMY")).alias("fragment"))
    return snapshots.fragments(chunks, views.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("chunk_id")))


# --- evidence ------------------------------------------------------------------------------------------------------


@query(f"""
    WITH RECURSIVE {BM25.format(idf=LUCENE, k=30)},
    h AS (SELECT query_id, rank AS pos, doc_id AS id, length(text) AS cost FROM bm JOIN documents USING (doc_id)),
    nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, id % 7 ORDER BY pos) > 2 AS later FROM h),
    g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY later, pos) AS pos, id, cost FROM nth),
    {FILLED.format(name="a", h="h", k=8, budget=15_998)}, {FILLED.format(name="b", h="g", k=8, budget=15_998)},
    x AS (SELECT query_id, arg_max(taken, pos) AS ranked FROM a GROUP BY ALL), y AS (SELECT query_id, arg_max(taken, pos) AS taken, arg_max(dropped, pos) AS dropped FROM b GROUP BY ALL)
    SELECT query_id, coalesce(array_to_string(taken, ','), '') AS selected, coalesce(array_to_string(list_filter(ranked, lambda i: NOT list_contains(taken, i)), ','), '') AS over_quota, coalesce(array_to_string(dropped, ','), '') AS over_budget
    FROM x JOIN y USING (query_id)""")
def ref_evidence_selection(spark, d):
    cost = views.read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("cost"))
    hits = bm25_hits(spark, d, 30).join(cost, "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 7).alias("doc_id"), "rank", "cost")
    return evidence.selected(hits, 8, 2, 16_000).select("query_id", listed("selected"), listed("over_quota"), listed("over_budget"))


@query(f"""
    WITH {BM25.format(idf=LUCENE, k=10)},
    e AS (SELECT query_id, list(doc_id ORDER BY rank) AS ids FROM bm GROUP BY ALL),
    g AS (SELECT query_id, doc_id + (doc_id % 3 = 0)::INT * 1000000 AS id, doc_id % 2 = 0 AS good, doc_id, rank FROM bm WHERE doc_id % 5 > 0)
    SELECT query_id, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FROM g WHERE g.query_id = e.query_id AND good AND id = doc_id), '') AS relevant,
        coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM g WHERE g.query_id = e.query_id AND id <> doc_id), '') AS unknown,
        coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FROM bm WHERE bm.query_id = e.query_id AND (doc_id % 5 = 0 OR doc_id % 3 = 0)), '') AS missing
    FROM e""")
def ref_grades(spark, d):
    hits = bm25_hits(spark, d, 10)
    ids = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    strange = F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1_000_000).otherwise(0)
    grades = hits.where("doc_id % 5 > 0").select("query_id", strange.alias("chunk_id"), (F.col("doc_id") % 2 == 0).alias("relevant"))
    return evidence.graded(ids, grades).select("query_id", listed("relevant"), listed("unknown"), listed("missing"))


@query("SELECT o_orderkey, CASE WHEN coalesce(n, 0) = 0 THEN 'nothing was found' WHEN big = 0 THEN 'nothing fitted' WHEN f = 0 THEN 'nothing was relevant' WHEN r = 0 THEN 'nothing was cited' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 10) AS big, count(*) FILTER (l_quantity > 10 AND l_linestatus = 'F') AS f, count(*) FILTER (l_quantity > 10 AND l_linestatus = 'F' AND l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def ref_absence(spark, d):
    big, f, r = F.col("l_quantity") > 10, F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    counts = views.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("retrieved"), F.count_if(big).alias("selected"), F.count_if(big & f).alias("relevant"), F.count_if(big & f & r).alias("cited"))
    return evidence.absence(views.read(spark, d, "orders").select("o_orderkey").join(counts, "o_orderkey", "left")).select("o_orderkey", "reason")


# --- catalog -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'cold') OR contains(lower(p_brand), 'cold') OR contains(lower(p_type), 'cold')")
def ref_search_catalog(spark, d):
    return views.read(spark, d, "part").where(admin.holds(" COLD ", "p_name", "p_brand", "p_type")).select("p_partkey")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/@]+(/|$)') AND NOT regexp_matches(url, '(?i)((api[_-]?key|token|secret|password)\\s*[=:]\\s*)[^\\s,;]+|sk-[A-Za-z0-9_-]{8,}') THEN url ELSE '' END AS url FROM pages".replace("\\\\", "\\"))
def ref_public_urls(spark, d):
    return views.read(spark, d, "pages").select("page_id", admin.public_url(F.col("url")).alias("url"))


@query("SELECT regexp_extract(url, '^https?://([^/?]+)', 1) AS host, CASE WHEN contains(url, '/v1/') THEN 'openai_compatible' ELSE 'external_api' END AS provider, false AS local, count(*) AS n FROM pages GROUP BY ALL")
def ref_providers(spark, d):
    p = views.read(spark, d, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host"), admin.provider(F.col("url")).alias("x"))
    return p.groupBy("host", "x.provider", "x.local").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def ref_newest_jobs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    jobs = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"), status.alias("status"), (F.col("o_orderpriority") == "5-LOW").alias("archived"), "o_orderstatus")
    return admin.newest_jobs(jobs).select("job_id", F.col("o_orderstatus").alias("status"))


@query(f"WITH {CHUNK} SELECT doc_id, line_no AS ordinal, body[1:60] AS body FROM chunk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 3")
def ref_preview(spark, d):
    return admin.preview(views.chunks(spark, d).withColumnRenamed("line_no", "ordinal"), 3, 60)


@query("SELECT coalesce(nullif(o.o_orderpriority, '5-LOW'), 'unsectioned') AS section, v.o_orderstatus AS model, count(*) AS n, count(v.o_orderkey) AS embedded FROM orders o LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') v USING (o_orderkey) GROUP BY 1, 2")
def ref_section_counts(spark, d):
    o = views.read(spark, d, "orders")
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("section"))
    return admin.section_counts(chunks, o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderstatus").alias("model")), ["model"])


@query("SELECT c_custkey AS doc_id, CASE WHEN s_suppkey IS NULL THEN 'unknown' WHEN s_nationkey IS NOT DISTINCT FROM c_nationkey THEN 'current' ELSE 'stale' END AS status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def ref_ingestion_status(spark, d):
    c = views.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("nation"))
    return admin.ingestion_status(c, views.read(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").alias("nation")), ["nation"])


@query("""
    WITH h AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag = 'A') AS a, max(CASE WHEN l_returnflag = 'R' THEN l_linestatus END) AS named, max(CASE WHEN l_returnflag = 'A' THEN l_linestatus END) AS archive FROM lineitem GROUP BY ALL)
    SELECT o_orderkey AS doc_id, CASE WHEN p > 1 OR a > 1 THEN 'ambiguous' WHEN coalesce(p, 0) = 0 THEN 'missing' WHEN a = 1 AND named IS DISTINCT FROM archive THEN 'unlinked' ELSE 'ready' END AS state FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""")
def ref_source_states(spark, d):
    role = F.when(F.col("l_returnflag") == "R", "primary").when(F.col("l_returnflag") == "A", "archive")
    artifacts = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), role.alias("role"), F.col("l_linestatus").alias("sha256"), F.col("l_linestatus").alias("archive_sha256"))
    return admin.source_states(views.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), artifacts)


@query("SELECT c_nationkey AS code, arg_min(c_name, c_custkey) AS issuer FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY ALL")
def ref_issuer_codes(spark, d):
    listing = views.read(spark, d, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_custkey").alias("at"), F.col("c_name").alias("issuer"))
    known = views.read(spark, d, "supplier").select(F.col("s_nationkey").alias("code")).join(listing, "code", "left_semi")
    return admin.issuers_of(known, listing)


@query("SELECT o_custkey, greatest(least(1000 + o_custkey, 5000) - 40 * count(*), 0) AS left_tokens FROM orders GROUP BY o_custkey")
def ref_allowance(spark, d):
    runs = views.read(spark, d, "orders").groupBy("o_custkey").agg((40 * F.count(F.lit(1))).alias("used_tokens"))
    runs = runs.withColumn("own", 1000 + F.col("o_custkey")).withColumn("server", F.lit(5000))
    return admin.allowance(runs, {"tokens": ["own", "server"]}).select("o_custkey", "left_tokens")


# --- chunks --------------------------------------------------------------------------------------------------------


@query(r"""
    WITH RECURSIVE """ + DOCUMENT + r""",
    cut AS (SELECT doc_id, issuer || ' FY' || fiscal_year AS header, string_split(replace(replace(regexp_replace(text, '([.!?。！？])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10) || chr(10), chr(10) || chr(1) || chr(10)), chr(10) || chr(10), chr(10) || chr(1) || chr(10)), chr(1)) AS parts FROM document),
    part AS MATERIALIZED (
        SELECT doc_id, k, s, len(regexp_extract_all(lower(header), '[\p{L}\p{M}\p{N}]+')) AS head, len(regexp_extract_all(lower(s), '[\p{L}\p{M}\p{N}]+')) AS tokens
        FROM (SELECT doc_id, header, unnest(list_filter(parts, lambda x: x <> '')) AS s, unnest(range(1, len(list_filter(parts, lambda x: x <> '')) + 1)) AS k FROM cut)),
    pass AS (
        SELECT DISTINCT doc_id, 0::BIGINT AS k, -1 AS piece, 0::BIGINT AS held FROM part
        UNION ALL
        SELECT doc_id, k, piece + (NOT joins)::INT, tokens + CASE WHEN joins THEN held ELSE 0 END
        FROM (SELECT p.doc_id, q.k, p.piece, p.held, q.tokens, p.piece >= 0 AND q.head + p.held + q.tokens <= 200 AS joins FROM pass p JOIN part q ON q.doc_id = p.doc_id AND q.k = p.k + 1))
    SELECT doc_id, piece, sum(length(s))::BIGINT AS n_chars, sha256(string_agg(s, '' ORDER BY k)) AS body_sha256 FROM pass JOIN part USING (doc_id, k) GROUP BY doc_id, piece""")
def ref_pieces(spark, d):
    sections = views.documents(spark, d).select("doc_id", F.lit(0).alias("section"), F.concat("issuer", F.lit(" FY"), "fiscal_year").alias("header"), "text")
    out = chunking.pieces(sections, chunking.Budget(200, 1_000_000, 10_000_000))
    return out.select("doc_id", "piece", F.length("body").cast("long").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query(f"WITH {CHUNK} SELECT doc_id, line_no // 4 AS part, min(start_char)::BIGINT AS start_char, max(end_char)::BIGINT AS end_char FROM chunk GROUP BY ALL")
def ref_enclosing_spans(spark, d):
    blocks = views.chunks(spark, d).withColumn("part", F.floor(F.col("line_no") / 4).cast("int")).withColumn("source_group", F.col("part"))
    return chunking.enclosing(blocks, ["doc_id", "part"], "line_no")


@query(f"""
    WITH {DOCUMENT}, c AS (SELECT doc_id, issuer || ' FY' || fiscal_year || ' · ' || CASE WHEN doc_id % 4 = 0 THEN 'Unnumbered section' ELSE form END AS c, form, language, doc_id % 5 AS k FROM document)
    SELECT doc_id, c || CASE WHEN doc_id % 4 = 0 THEN ' · ' || form ELSE '' END || CASE WHEN k = 0 THEN '' WHEN k = 1 THEN '' ELSE ' · ' || language END AS header FROM c""")
def ref_context_headers(spark, d):
    v = views.documents(spark, d)
    label = F.when(F.col("doc_id") % 4 > 0, F.col("form"))
    heading = F.when(F.col("doc_id") % 5 == 1, F.col("form")).when(F.col("doc_id") % 5 > 1, F.col("language"))
    return v.select("doc_id", chunking.context_header(chunking.citation(F.col("issuer"), F.col("fiscal_year"), label), F.col("form"), heading).alias("header"))


@query(f"WITH {CHUNK} SELECT doc_id, line_no, sha256('[' || doc_id || ',' || start_char || ',' || end_char || ',' || to_json(body)::VARCHAR || ',' || coalesce(to_json(nullif(language, 'de'))::VARCHAR, 'null') || ']') AS stable_key FROM chunk")
def ref_stable_keys(spark, d):
    c = views.chunks(spark, d).withColumn("section", F.nullif("language", F.lit("de")))
    return c.select("doc_id", "line_no", chunking.stable_key(["doc_id", "start_char", "end_char"], ["body", "section"]).alias("stable_key"))
