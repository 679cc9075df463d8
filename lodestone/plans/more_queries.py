"""More queries of the reference operators: joins, sets, scalar functions, identities, control."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.operators import guards, parsing
from lodestone.sources import views

from .queries import ORACLE, QUERIES, ledger, query

__all__ = ["ORACLE", "QUERIES"]

CUSTOMERS = "f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')"


def customers(spark, d, status):
    return views.read(spark, d, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k")).distinct()


@query(f"WITH {CUSTOMERS} SELECT k FROM f INTERSECT SELECT k FROM o")
def ref_set_intersection(spark, d):
    return customers(spark, d, "F").intersect(customers(spark, d, "O"))


@query(f"WITH {CUSTOMERS} SELECT k FROM f EXCEPT SELECT k FROM o")
def ref_set_difference(spark, d):
    return customers(spark, d, "F").subtract(customers(spark, d, "O"))


@query(f"WITH {CUSTOMERS} SELECT coalesce(f.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'first' ELSE 'second' END AS side FROM f FULL JOIN o USING (k) WHERE f.k IS NULL OR o.k IS NULL")
def ref_set_symmetric(spark, d):
    a, b = customers(spark, d, "F").withColumn("a", F.lit(1)), customers(spark, d, "O").withColumn("b", F.lit(1))
    return a.join(b, "k", "full").where("a IS NULL OR b IS NULL").select("k", F.when(F.col("b").isNull(), "first").otherwise("second").alias("side"))


@query("SELECT l_orderkey, len(list_distinct(list(l_returnflag))) = 1 AS same FROM lineitem GROUP BY ALL")
def ref_subset_test(spark, d):
    got = views.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return got.select("l_orderkey", (F.size(F.array_except("flags", F.slice("flags", 1, 1))) == 0).alias("same"))


@query(r"WITH t AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS l FROM documents)), f AS (SELECT doc_id, w, min(i) AS i FROM t GROUP BY ALL), j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words, count(*) AS n FROM f GROUP BY doc_id) SELECT doc_id, coalesce(words, '') AS words, coalesce(n, 0) AS n FROM documents LEFT JOIN j USING (doc_id)")
def ref_ordered_distinct(spark, d):
    w = views.read(spark, d, "documents").select("doc_id", F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    return w.select("doc_id", F.array_join("w", " ").alias("words"), F.size("w").cast("long").alias("n"))


@query("WITH a AS (SELECT p_partkey AS a_id, p_size * 10 AS a_start, p_size * 10 + p_partkey % 90 AS a_end FROM part), b AS (SELECT s_suppkey AS b_id, s_suppkey % 500 AS b_start, s_suppkey % 500 + 7 AS b_end FROM supplier) SELECT a_id, b_id FROM a JOIN b ON a_start < b_end AND b_start < a_end AND a_start < a_end")
def ref_overlap_join(spark, d):
    p, s = views.read(spark, d, "part"), views.read(spark, d, "supplier")
    a = p.selectExpr("p_partkey AS a_id", "p_size * 10 AS a_start", "p_size * 10 + p_partkey % 90 AS a_end")
    return parsing.overlapping(a, s.selectExpr("s_suppkey AS b_id", "s_suppkey % 500 AS b_start", "s_suppkey % 500 + 7 AS b_end"))


@query("SELECT n_name, r_name, count(c_custkey) AS customers, coalesce(sum(c_acctbal), 0)::DECIMAL(18, 2)::DOUBLE AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def ref_dimension_joins(spark, d):
    n, r, c = (views.read(spark, d, t) for t in ("nation", "region", "customer"))
    joined = n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(c, c["c_nationkey"] == n["n_nationkey"], "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"), F.coalesce(F.sum("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)").cast("double").alias("balance"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def ref_visible(spark, d):
    urgent = views.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return views.read(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT count(*) AS jobs, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS archived, count(*) FILTER (o_orderstatus <> 'F') AS visible FROM orders")
def ref_history_counts(spark, d):
    s = F.col("o_orderstatus")
    return views.read(spark, d, "orders").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(s == "O").alias("active"), F.count_if(s == "F").alias("archived"), F.count_if(s != "F").alias("visible"))


@query("WITH e AS (SELECT sha256(text) AS d FROM documents), p AS (SELECT d[1:2] AS p, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM e GROUP BY 1) SELECT sha256(string_agg(d, ',' ORDER BY p)) AS digest FROM p")
def ref_rows_digest(spark, d):
    return identity.rows_digest(views.read(spark, d, "documents"), "text")


@query(r"""
    WITH w AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS w FROM conversations),
    h AS (SELECT id, (('0x' || sha256(w)[1:16])::UBIGINT % 64)::INT AS place, CASE WHEN ('0x' || sha256(w)[17:18])::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM w),
    v AS (SELECT id, place, sum(s)::DOUBLE AS v FROM h GROUP BY ALL)
    SELECT id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 9) AS value FROM v QUALIFY v <> 0""")
def ref_hashed_vectors(spark, d):
    c = views.read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), T.tokens(F.col("text")).alias("w")).where("size(w) > 0")
    v = identity.hashed_vector(c, "id", F.col("w"), 64).select("id", F.posexplode("embedding").alias("place", "value"))
    return v.where("value <> 0").withColumn("value", F.round("value", 9))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN regexp_extract(text[1:80], '(?s)^(.*)\s\S*$', 1) = '' THEN text[1:80] ELSE regexp_extract(text[1:80], '(?s)^(.*)\s\S*$', 1) END AS reason FROM documents")
def ref_truncate(spark, d):
    return views.read(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 80).alias("reason"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, len(json_keys(props)) AS n FROM events")
def ref_json_paths(spark, d):
    e = views.read(spark, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE lower(p_name) LIKE '%a%' AND p_size BETWEEN 10 AND 30 GROUP BY ALL HAVING count(*) > 1")
def ref_having(spark, d):
    p = views.read(spark, d, "part").where(F.lower("p_name").contains("a") & F.col("p_size").between(10, 30))
    return p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
    WITH RECURSIVE l AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (
        SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS "at", NULL::BOOLEAN AS admitted, []::BIGINT[] AS live FROM l
        UNION ALL
        SELECT user_id, n, "at", admitted, CASE WHEN admitted THEN list_append(live, "at") ELSE live END FROM (
            SELECT l.user_id, l.n, l."at", r.live, len(list_filter(r.live, lambda x: x > l."at" - 3600)) < 2 AND len(list_filter(r.live, lambda x: x > l."at" - 86400)) < 5 AS admitted
            FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1))
    SELECT user_id, "at", admitted FROM r WHERE n > 0""")
def ref_admission(spark, d):
    log = ledger(spark, d).select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return guards.admitted(log, "user_id", "at", {3_600: 2, 86_400: 5})


@query()
def ref_languages(spark, d):
    return views.read(spark, d, "conversations").select("conv_id", "turn", Q.languages(F.col("text")).alias("languages"), T.question_years(F.col("text"), 2026).alias("years"))


@query()
def ref_canonical_json(spark, d):
    return views.read(spark, d, "events").select("event_id", F.sha2(identity.canonical("props").cast("binary"), 256).alias("sha256"))
