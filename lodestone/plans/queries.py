"""Queries of the retrieval and evaluation operators over whole tables, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.spans import covered
from lodestone.operators import catalog, evaluation, indexing, parsing, ranking, scans, usage
from lodestone.sources import views
from lodestone.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# DuckDB's forms of the views
DOCUMENT = """document AS (
    SELECT doc_id, lang AS language, source AS issuer, (2019 + doc_id % 6)::INT AS fiscal_year,
           ['10-K', '10-Q', '8-K'][doc_id % 3 + 1] AS form, sha256(text) AS source_sha256, length(text)::BIGINT AS n_chars, text
    FROM documents)"""
CHUNK = """chunk AS (
    SELECT doc_id, language, line_no::INT AS line_no, start_char, start_char + length(body) AS end_char, body FROM (
        SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char
        FROM (SELECT doc_id, lang AS language, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))
    WHERE trim(body) <> '')"""
POSTING = r"""token AS (SELECT doc_id, lang AS language, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS lexeme FROM documents),
posting AS (SELECT doc_id, language, lexeme, count(*) AS tf FROM token GROUP BY ALL)"""
GOLD = """gold AS (
    SELECT item_id AS query_id, doc_id, instr(d.text, b.text) - 1 AS start_char, instr(d.text, b.text) - 1 + length(b.text) AS end_char,
           row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS gold_no
    FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""
BM25 = POSTING.replace("{", "{{").replace("}", "}}") + r""",
len AS (SELECT doc_id, language, sum(tf) AS dl FROM posting GROUP BY ALL),
freq AS (SELECT language, lexeme, count(*) AS df FROM posting GROUP BY ALL),
stat AS (SELECT language, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS lexeme FROM benchmark),
scored AS (
    SELECT query_id, doc_id, round(sum({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM posting JOIN asked USING (lexeme) JOIN freq USING (language, lexeme) JOIN len USING (doc_id, language) JOIN stat USING (language) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored),
bm AS (SELECT * FROM ranked WHERE rank <= {k})"""
LUCENE, ROBERTSON = "ln(1 + (n - df + 0.5) / (df + 0.5))", "ln((n - df + 0.5) / (df + 0.5))"
LEDGER = """ledger AS (SELECT event_id, ts, user_id, event_type, round(value, 4)::DECIMAL(18, 4) AS cost, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens FROM events)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a usage ledger: exact costs, tokens from the properties."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0).cast("long"))
    return views.read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.round("value", 4).cast("decimal(18,4)").alias("cost"), k.alias("tokens"))


def ranked(spark: SparkSession, d: str, lanes: dict[str, str], k: int) -> DataFrame:
    texts = views.read(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), "text")
    return scans.ranked(views.questions(spark, d), texts, lanes, k)


def bm25_hits(spark: SparkSession, d: str, k: int, variant: str = "lucene") -> DataFrame:
    return ranked(spark, d, {variant: variant}, k).drop("lane")


# --- index -------------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNK} SELECT doc_id, line_no, start_char, end_char, sha256(body) AS body_sha256 FROM chunk")
def ref_chunks(spark, d):
    return views.chunks(spark, d).select("doc_id", "line_no", "start_char", "end_char", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query(f"WITH {POSTING} SELECT language, lexeme, count(*) AS df FROM posting GROUP BY ALL")
def ref_document_frequency(spark, d):
    return indexing.document_frequency(views.postings(spark, d))


@query(f"WITH {POSTING}, len AS (SELECT doc_id, language, sum(tf) AS dl FROM posting GROUP BY ALL) SELECT language, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY ALL")
def ref_corpus_statistics(spark, d):
    return indexing.corpus_statistics(views.postings(spark, d))


@query(f"WITH {POSTING} SELECT count(*) AS n_terms, count(DISTINCT doc_id) AS n_lengths, count(DISTINCT (language, lexeme)) AS n_lexemes FROM posting")
def ref_index_receipt(spark, d):
    return indexing.receipt(views.postings(spark, d))


@query(f"WITH {CHUNK} SELECT doc_id, sha256(string_agg(row, ',' ORDER BY row)) AS fingerprint FROM (SELECT doc_id, start_char || '|' || end_char || '|' || body AS row FROM chunk) GROUP BY doc_id")
def ref_index_fingerprint(spark, d):
    return indexing.fingerprint(views.chunks(spark, d), "doc_id", ["start_char", "end_char", "body"])


# --- ranking -----------------------------------------------------------------------------------------------------


@query(f"WITH {BM25.format(idf=LUCENE, k=10)} SELECT query_id, doc_id, score, rank FROM bm")
def ref_bm25(spark, d):
    return bm25_hits(spark, d, 10).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {BM25.format(idf=ROBERTSON, k=10)} SELECT query_id, doc_id, score, rank FROM bm")
def ref_bm25_robertson(spark, d):
    return bm25_hits(spark, d, 10, "robertson").select("query_id", "doc_id", "score", "rank")


def positions(spark, d):
    t = views.read(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("place", "lexeme"))
    return t.withColumn("place", F.col("place") + 1)


@query(r"""
    WITH p AS (SELECT doc_id, unnest(l) AS lexeme, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS l FROM documents)),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS lexeme FROM benchmark),
    n AS (SELECT query_id, count(*) AS n FROM asked GROUP BY ALL),
    met AS (SELECT query_id, doc_id, count(DISTINCT lexeme) AS k FROM p JOIN asked USING (lexeme) GROUP BY ALL),
    h AS (SELECT query_id, doc_id, n, lexeme, place FROM met JOIN n USING (query_id) JOIN asked USING (query_id) JOIN p USING (doc_id, lexeme) WHERE k = n),
    last AS (SELECT e.query_id, e.doc_id, e.n, e.place AS e, b.lexeme, max(b.place) AS s FROM h e JOIN h b ON e.query_id = b.query_id AND e.doc_id = b.doc_id AND b.place <= e.place GROUP BY ALL),
    full_ AS (SELECT query_id, doc_id, n, e, min(s) AS s FROM last GROUP BY query_id, doc_id, n, e HAVING count(*) = n),
    cover AS (SELECT query_id, doc_id, n, s, min(e) AS e FROM full_ GROUP BY ALL),
    gap AS (SELECT *, (s + e) / 2 - lag((s + e) / 2) OVER (PARTITION BY query_id, doc_id ORDER BY e) AS gap FROM cover),
    summed AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (e - s + 2 - n)) AS w, avg(CASE WHEN gap IS NOT NULL THEN greatest(gap, 1) END) AS dist FROM gap GROUP BY ALL),
    dl AS (SELECT doc_id, count(*) AS dl FROM p GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, round(w / coalesce(dist, 1) / (1 + ln(dl)), 9) AS score FROM summed JOIN dl USING (doc_id))
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10""")
def ref_cover_density(spark, d):
    scored = ranking.cover_density(views.questions(spark, d), positions(spark, d)).withColumn("score", F.round("score", 9))
    return ranking.top_k(scored, 10, "doc_id").select("query_id", "doc_id", "score", "rank")


COSINE = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
near AS (
    SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)"""


def nearest(spark, d, k):
    v = views.read(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.cosine_search(q, v, k, 9)


@query(f"WITH {COSINE} SELECT query_id, vec_id, score, rank FROM nearest WHERE rank <= 10")
def ref_cosine_search(spark, d):
    return nearest(spark, d, 10).select("query_id", "vec_id", "score", "rank")


LANES = BM25.format(idf=LUCENE, k=20) + ", " + """lex2 AS (
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, count(*) AS shared FROM posting JOIN asked USING (lexeme) GROUP BY ALL)),
lanes AS (SELECT query_id, 'bm25' AS lane, doc_id, rank FROM bm UNION ALL SELECT query_id, 'overlap', doc_id, rank FROM lex2 WHERE rank <= 20)"""


def lanes(spark, d):
    return ranked(spark, d, {"bm25": "lucene", "overlap": "overlap"}, 20).drop("score")


FUSED = """fused AS (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, lane, doc_id, min(rank) AS rank FROM lanes GROUP BY ALL) GROUP BY ALL))"""


@query(f"WITH {LANES}, {FUSED} SELECT query_id, doc_id, rank FROM fused WHERE rank <= 10")
def ref_hybrid_fusion(spark, d):
    fused = ranking.fuse(lanes(spark, d), 1_000).withColumn("score", F.round("score", 12)).drop("rank")
    return ranking.top_k(fused, 10, "doc_id").select("query_id", "doc_id", "rank")


@query(f"WITH {LANES} SELECT query_id, doc_id, string_agg(lane || ':' || rank, ',' ORDER BY lane, rank) AS lanes FROM lanes GROUP BY ALL")
def ref_component_ranks(spark, d):
    return ranking.component_ranks(lanes(spark, d)).select("query_id", "doc_id", F.array_join(F.transform("lanes", lambda x: F.concat(x["lane"], F.lit(":"), x["rank"])), ",").alias("lanes"))


@query(f"WITH {BM25.format(idf=LUCENE, k=10)} SELECT query_id, fiscal_year, doc_id, rank FROM (SELECT query_id, (2019 + doc_id % 6)::INT AS fiscal_year, doc_id, row_number() OVER (PARTITION BY query_id, doc_id % 6 ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 3")
def ref_compare_years(spark, d):
    scored = ranking.bm25(views.questions(spark, d), views.postings(spark, d), lengths=views.lengths(spark, d)).withColumn("score", F.round("score", 6)).withColumn("fiscal_year", (2019 + F.col("doc_id") % 6).cast("int"))
    order = Window.partitionBy("query_id", "fiscal_year").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("query_id", "fiscal_year", "doc_id", "rank")


@query(f"WITH {BM25.format(idf=LUCENE, k=30)} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY nth > 2, rank) AS place FROM (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id, doc_id % 7 ORDER BY rank) AS nth FROM bm)")
def ref_document_preference(spark, d):
    hits = bm25_hits(spark, d, 30).select("query_id", F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("doc_id"), "rank")
    return ranking.prefer_documents(hits, 2).select("query_id", F.col("id").alias("doc_id"), "place")


@query(f"WITH {BM25.format(idf=LUCENE, k=20)}, b AS (SELECT query_id, bm.doc_id, rank, min(rank) OVER (PARTITION BY query_id, trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS first FROM bm JOIN documents d USING (doc_id)) SELECT a.query_id, a.doc_id, o.doc_id AS owner FROM b a JOIN bm o ON a.query_id = o.query_id AND a.first = o.rank")
def ref_text_owners(spark, d):
    texts = views.read(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return ranking.text_owner(bm25_hits(spark, d, 20).join(texts, "doc_id")).select("query_id", "doc_id", "owner")


# DuckDB's form of filling slots in order, for hits h(query_id, pos, id, cost)
FILLED = """{name} AS (
    SELECT query_id, 0::BIGINT AS pos, {budget}::BIGINT AS room, []::BIGINT[] AS taken, []::BIGINT[] AS dropped FROM (SELECT DISTINCT query_id FROM {h})
    UNION ALL
    SELECT f.query_id, h.pos, CASE WHEN len(taken) < {k} AND cost <= room THEN room - cost ELSE room END,
        CASE WHEN len(taken) < {k} AND cost <= room THEN list_append(taken, id) ELSE taken END, CASE WHEN len(taken) < {k} AND cost > room THEN list_append(dropped, id) ELSE dropped END
    FROM {name} f JOIN {h} h ON h.query_id = f.query_id AND h.pos = f.pos + 1)"""


@query(f"WITH RECURSIVE {BM25.format(idf=LUCENE, k=20)}, h AS (SELECT query_id, rank AS pos, doc_id AS id, length(text) AS cost FROM bm JOIN documents USING (doc_id)), {FILLED.format(name='f', h='h', k=5, budget=12_000)} SELECT query_id, coalesce(array_to_string(arg_max(taken, pos), ','), '') AS taken FROM f GROUP BY ALL")
def ref_budgeted_fill(spark, d):
    cost = views.read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("cost"))
    return ranking.fill(bm25_hits(spark, d, 20).join(cost, "doc_id"), 5, 12_000).select("query_id", listed("taken"))


def listed(ids: str):
    """An array of ids as a text."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias(ids)


@query(f"WITH {BM25.format(idf=LUCENE, k=10)}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum({ROBERTSON} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM posting JOIN asked USING (lexeme) JOIN freq USING (language, lexeme) JOIN len USING (doc_id, language) JOIN stat USING (language) GROUP BY ALL)) SELECT query_id, doc_id, CASE WHEN b.rank IS NULL THEN 'miss_to_hit' WHEN a.rank IS NULL THEN 'hit_to_miss' ELSE 'stable_hit' END AS change, b.rank - a.rank AS delta FROM bm b FULL JOIN (SELECT * FROM r WHERE rank <= 10) a USING (query_id, doc_id)")
def ref_rank_transitions(spark, d):
    both = ranked(spark, d, {"before": "lucene", "after": "robertson"}, 10)
    return ranking.transitions(both.where("lane = 'before'"), both.where("lane = 'after'"))


# --- evaluation --------------------------------------------------------------------------------------------------


def gold(spark, d):
    g = views.gold(spark, d).withColumnRenamed("item_id", "query_id")
    return g.withColumn("gold_no", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))


def span_hits(spark, d):
    hits = bm25_hits(spark, d, 10)
    return hits.join(views.chunks(spark, d, hits).groupBy("doc_id").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")), "doc_id")


@query(f"WITH {GOLD} SELECT query_id, doc_id, start_char, end_char, gold_no FROM gold")
def ref_gold_spans(spark, d):
    return gold(spark, d)


CASES = f"""{BM25.format(idf=LUCENE, k=10)}, {GOLD},
found AS (SELECT g.query_id, g.gold_no, max(b.rank IS NOT NULL) AS found, min(b.rank) AS pos FROM gold g LEFT JOIN bm b ON g.query_id = b.query_id AND g.doc_id = b.doc_id GROUP BY ALL),
cases AS (SELECT query_id, avg(found::INT) AS recall, (min(pos) IS NOT NULL)::INT AS hit, coalesce(1.0::DOUBLE / min(pos), 0) AS reciprocal_rank, min(pos) AS first_rank FROM found GROUP BY query_id)"""


@query(f"WITH {CASES} SELECT * FROM cases")
def ref_case_scores(spark, d):
    return evaluation.case_scores(views.questions(spark, d), span_hits(spark, d), gold(spark, d), 10)


@query(f"WITH {CASES} SELECT count(*) AS n, avg(recall) AS recall, avg(hit) AS hit_rate, avg(reciprocal_rank) AS mrr FROM cases")
def ref_suite_metrics(spark, d):
    return evaluation.suite(evaluation.case_scores(views.questions(spark, d), span_hits(spark, d), gold(spark, d), 10))


@query(f"WITH {CASES} SELECT query_id % 4 AS category, count(*) AS n, avg(recall) AS recall, avg(hit) AS hit_rate, avg(reciprocal_rank) AS mrr FROM cases GROUP BY ALL")
def ref_category_metrics(spark, d):
    scores = evaluation.case_scores(views.questions(spark, d), span_hits(spark, d), gold(spark, d), 10)
    return evaluation.suite(scores.withColumn("category", F.col("query_id") % 4), "category")


@query(f"WITH {GOLD}, {CHUNK}, c AS (SELECT g.query_id, g.doc_id, sum(greatest(least(c.end_char, g.end_char) - greatest(c.start_char, g.start_char), 0)) AS covered FROM gold g JOIN chunk c USING (doc_id) GROUP BY ALL) SELECT query_id, doc_id, covered::BIGINT AS covered FROM c")
def ref_union_coverage(spark, d):
    spans = views.chunks(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e"))).alias("spans"))
    return gold(spark, d).join(spans, "doc_id").select("query_id", "doc_id", covered(F.col("spans"), F.col("start_char"), F.col("end_char")).alias("covered"))


@query("SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 9) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS largest FROM events GROUP BY ALL")
def ref_latency(spark, d):
    return evaluation.latency(views.read(spark, d, "events"), "value", "event_type").withColumn("total", F.round("total", 6)).withColumn("mean", F.round("mean", 9))


METRICS = "m AS (SELECT l_returnflag AS metric, l_linestatus AS run, round(avg(l_discount), 9) AS value FROM lineitem GROUP BY ALL)"


def metrics(spark, d, run):
    return views.read(spark, d, "lineitem").where(F.col("l_linestatus") == run).groupBy(F.col("l_returnflag").alias("metric")).agg(F.round(F.avg("l_discount"), 9).alias("value"))


@query(f"WITH {METRICS} SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.value, 0) AS before, coalesce(b.value, 0) AS after, round(coalesce(b.value, 0) - coalesce(a.value, 0), 9) AS delta, round(coalesce(b.value, 0) - coalesce(a.value, 0), 9) < -0.01 AS regressed FROM (SELECT * FROM m WHERE run = 'F') a FULL JOIN (SELECT * FROM m WHERE run = 'O') b USING (metric)")
def ref_regression_gate(spark, d):
    both = evaluation.compare_metrics(metrics(spark, d, "F"), metrics(spark, d, "O")).withColumn("delta", F.round("delta", 9))
    return evaluation.regressions(both, 0.01)


@query("WITH r AS (SELECT source AS arm, avg(n_chars) FILTER (lang = 'en') AS native, avg(n_chars) FILTER (lang = 'de') AS foreign_ FROM documents GROUP BY ALL) SELECT arm, native, foreign_ AS foreign, foreign_ / nullif(native, 0) AS ratio, foreign_ / nullif(native, 0) >= 0.85 - 1e-12 AS passes FROM r")
def ref_parity_gate(spark, d):
    rows = views.read(spark, d, "documents").select(F.col("source").alias("arm"), F.col("lang").alias("language"), F.col("n_chars").cast("double").alias("recall"))
    return evaluation.parity(rows, ["arm"], "en", "de")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def ref_latest_row(spark, d):
    return evaluation.latest(views.read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH {BM25.format(idf=LUCENE, k=10)} SELECT count(*) AS cases, count(*) FILTER (n IS NULL) AS empty, (count(*) FILTER (n IS NULL))::DOUBLE / count(*) AS empty_rate, avg(coalesce(n, 0)) AS mean_candidates FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n FROM scored GROUP BY ALL) ON item_id = query_id")
def ref_candidate_coverage(spark, d):
    return evaluation.candidate_coverage(views.questions(spark, d), ranking.bm25(views.questions(spark, d), views.postings(spark, d), lengths=views.lengths(spark, d)))


# --- catalog -----------------------------------------------------------------------------------------------------


@query(f"WITH {DOCUMENT} SELECT doc_id, language, issuer, fiscal_year, form, source_sha256, n_chars FROM document WHERE language IN ('de', 'en') AND fiscal_year IN (2020, 2021) AND form IN ('10-K')")
def ref_filters(spark, d):
    f = catalog.Filters(languages=("en", "de", "en"), fiscal_years=(2021, 2020), forms=("10-K",))
    return views.documents(spark, d).where(f.predicate()).drop("text")


@query("SELECT c_custkey AS doc_id, count(o_orderkey) AS n_chunks FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def ref_chunk_counts(spark, d):
    documents = views.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    return catalog.chunk_counts(documents, views.read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")))


@query("SELECT l_orderkey, count(*) AS chunks, count(*) FILTER (l_linestatus = 'F') AS embedded, (count(*) FILTER (l_linestatus = 'F'))::DOUBLE / count(*) AS share, CASE WHEN count(*) FILTER (l_linestatus = 'F') = count(*) THEN 'complete' WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN 'partial' ELSE 'missing' END AS status FROM lineitem GROUP BY ALL")
def ref_coverage_status(spark, d):
    return catalog.coverage(views.read(spark, d, "lineitem"), F.col("l_linestatus") == "F", "l_orderkey")


@query(f"WITH {DOCUMENT}, f AS (UNPIVOT (SELECT language, issuer, fiscal_year::VARCHAR AS fiscal_year, form FROM document) ON language, issuer, fiscal_year, form INTO NAME facet VALUE value) SELECT facet, value, count(*) AS n FROM f GROUP BY ALL")
def ref_facets(spark, d):
    return catalog.facets(views.documents(spark, d), ["language", "issuer", "fiscal_year", "form"])


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY ALL")
def ref_single_label(spark, d):
    return catalog.single_label(views.read(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query(f"WITH {DOCUMENT}, g AS (SELECT issuer, unnest([2019, 2020, 2021, 2022, 2023, 2024, 2025])::INT AS fiscal_year FROM (SELECT DISTINCT issuer FROM document)) SELECT issuer, fiscal_year, count(doc_id) AS n, greatest(10 - count(doc_id), 0) AS short FROM g LEFT JOIN document USING (issuer, fiscal_year) GROUP BY ALL")
def ref_portfolio_grid(spark, d):
    return catalog.target_grid(views.documents(spark, d), "issuer", "fiscal_year", list(range(2019, 2026)), 10)


@query("SELECT count(*) FILTER (doc_id IS NULL) AS no_id, count(*) FILTER (n_chars <> length(text)) AS wrong_length, count(*) FILTER (lang NOT IN ('en', 'fr', 'de', 'es')) AS other_language FROM documents")
def ref_validate(spark, d):
    rules = {"no_id": F.col("doc_id").isNotNull(), "wrong_length": F.col("n_chars") == F.length("text"), "other_language": F.col("lang").isin("en", "fr", "de", "es")}
    return catalog.validate(views.read(spark, d, "documents"), rules)


@query("WITH old AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'F'), new AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM old) GROUP BY ALL) SELECT * FROM old UNION ALL SELECT * FROM new")
def ref_merge_sources(spark, d):
    o = views.read(spark, d, "orders")
    return catalog.merge_sources(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 AND count(o_orderpriority) = count(*) THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY ALL")
def ref_unanimous(spark, d):
    return catalog.unanimous(views.read(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ref_pending(spark, d):
    c = views.read(spark, d, "customer").select("c_custkey", "c_name")
    return indexing.missing(c, views.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def ref_upsert(spark, d):
    c = views.read(spark, d, "customer").select("c_custkey", "c_acctbal")
    return indexing.merge(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25 OFFSET 50")
def ref_page(spark, d):
    order = [F.col("c_acctbal").desc_nulls_first(), F.col("c_custkey").asc()]
    rows = views.read(spark, d, "customer").select("c_custkey", "c_acctbal")
    _, cursor = catalog.page(rows, order, 50)
    return catalog.page(rows, order, 25, cursor)[0]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def ref_keyset_page(spark, d):
    return catalog.after(views.read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


@query("SELECT source, lang, count(*) AS n FROM documents WHERE contains(lower(text), lower('License')) GROUP BY ALL")
def ref_contains(spark, d):
    hit = views.read(spark, d, "documents").where(F.contains(F.lower("text"), F.lower(F.lit("License"))))
    return hit.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def ref_duplicate_identity(spark, d):
    g = views.read(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


# --- ledgers and logs ----------------------------------------------------------------------------------------------


@query(f"WITH {LEDGER} SELECT user_id, event_type, count(*) AS requests, sum(tokens)::BIGINT AS tokens, sum(cost)::DOUBLE AS cost, max(ts) AS last FROM ledger GROUP BY ALL")
def ref_usage(spark, d):
    return usage.totals(ledger(spark, d), "user_id", "event_type").withColumn("cost", F.col("cost").cast("double"))


@query(f"WITH {LEDGER} SELECT CASE grouping(event_type, user_id) WHEN 0 THEN 'inner' WHEN 1 THEN 'outer' ELSE 'all' END AS level, event_type, user_id, count(*) AS requests, sum(cost)::DOUBLE AS cost FROM ledger GROUP BY ROLLUP (event_type, user_id)")
def ref_usage_rollup(spark, d):
    return usage.rollup(ledger(spark, d), "event_type", "user_id").withColumn("cost", F.col("cost").cast("double"))


@query(f"WITH {LEDGER}, t AS (SELECT ts::DATE AS day, sum(ceil(cost * 1000000))::BIGINT AS micros FROM ledger GROUP BY ALL) SELECT day::VARCHAR AS day, micros, (sum(micros) OVER (ORDER BY day))::BIGINT AS running FROM t")
def ref_daily_cost(spark, d):
    return usage.daily(ledger(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {LEDGER} SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)) AS minute, (count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)) AS day FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM ledger)")
def ref_rate_windows(spark, d):
    log = ledger(spark, d).select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return usage.rate_windows(log, "user_id", "at", {"minute": 60, "day": 86_400}).select("event_id", "minute", "day")


@query(f"WITH {LEDGER} SELECT event_id, max(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS shown FROM ledger")
def ref_monotone_progress(spark, d):
    return usage.monotone(ledger(spark, d), "user_id", ["ts", "event_id"], "cost").select("event_id", F.col("shown").cast("double").alias("shown"))


@query(f"WITH {LEDGER} SELECT user_id, CASE WHEN sum(tokens) > 5000 THEN 'tokens' WHEN count(*) > 90 THEN 'requests' WHEN sum(cost) > 4000 THEN 'cost' END AS exhausted FROM ledger GROUP BY user_id")
def ref_first_exhausted(spark, d):
    t = usage.totals(ledger(spark, d), "user_id")
    return t.select("user_id", usage.first_exhausted({"tokens": (F.col("tokens"), 5000), "requests": (F.col("requests"), 90), "cost": (F.col("cost"), 4000)}).alias("exhausted"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY ALL")
def ref_last_state(spark, d):
    return usage.last_state(views.read(spark, d, "events"), "user_id")


@query("SELECT user_id, event_type, min(ts) AS started, max(ts) AS ended, round(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY ALL")
def ref_stage_clock(spark, d):
    return usage.stage_clock(views.read(spark, d, "events"), ["user_id", "event_type"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'P'")
def ref_queue_positions(spark, d):
    return usage.positions(views.read(spark, d, "orders").where("o_orderstatus = 'P'"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


# --- text ----------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;]+', '\1[REDACTED]', 'g'), '(?i)(Bearer\s+)[A-Za-z0-9._~+/-]+', '\1[REDACTED]', 'g')) AS shown FROM documents")
def ref_redaction(spark, d):
    return views.read(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")).cast("binary"), 256).alias("shown"))


@query("SELECT conv_id, turn, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM conversations")
def ref_collapse(spark, d):
    return views.read(spark, d, "conversations").select("conv_id", "turn", F.length(T.collapse(F.col("text"))).cast("long").alias("n"))


@query()
def ref_figures(spark, d):
    return views.read(spark, d, "conversations").select("conv_id", "turn", T.figures(F.col("text")).alias("figures"), T.years(F.col("text")).alias("years"), T.language(F.col("text")).alias("language"))


@query()
def ref_html_blocks(spark, d):
    return parsing.block_spans(parsing.leaf_blocks(views.read(spark, d, "pages")))


@query(f"WITH {CHUNK} SELECT doc_id, line_no, (sum((length(body) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM chunk")
def ref_sections(spark, d):
    return parsing.sections(views.chunks(spark, d), "doc_id", "line_no", F.length("body") < 40).select("doc_id", "line_no", "section")


@query("WITH r AS (SELECT p_partkey AS name, p_size AS low, p_size + p_partkey % 50 AS high FROM part), p AS (SELECT DISTINCT l_quantity::INT AS page FROM lineitem) SELECT page, arg_min(name, (high - low, name)) AS name FROM p JOIN r ON low <= page AND page <= high GROUP BY page")
def ref_narrowest_range(spark, d):
    ranges = views.read(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("low"), (F.col("p_size") + F.col("p_partkey") % 50).alias("high"))
    return parsing.narrowest(views.read(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("page")).distinct(), ranges)


# --- streams -------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def ref_stream_daily(spark, d):
    return streams.run(spark, streams.daily(streams.events(spark, d)), "complete").select("day", "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY ALL")
def ref_stream_job_state(spark, d):
    return streams.run(spark, streams.job_state(streams.events(spark, d)), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def ref_stream_distinct(spark, d):
    return streams.run(spark, streams.distinct_requests(streams.events(spark, d)), "append").select("user_id", "event_type")
