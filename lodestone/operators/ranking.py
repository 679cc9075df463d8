"""Ranking: BM25, cover density, exact cosine, reciprocal-rank fusion, deterministic top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.stemming import lexeme_counts
from lodestone.functions.text import tokens
from lodestone.functions.vectors import norm

from . import indexing


def idf(variant: str, n: Column, df: Column) -> Column:
    """Inverse document frequency; the second variant may be negative."""
    ratio = (n - df + 0.5) / (df + 0.5)
    return {"lucene": F.log1p(ratio), "robertson": F.ln(ratio)}[variant]


def check_bm25(k1: float, b: float, variant: str) -> None:
    if not 0 < k1 < float("inf") or not 0 <= b <= 1 or variant not in ("lucene", "robertson"):
        raise ValueError(f"k1 {k1}, b {b}, idf {variant}")


def bm25(questions: DataFrame, postings: DataFrame, k1: float = 1.2, b: float = 0.75, variant: str = "lucene", lengths: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents that have a token of the question, by their own language's statistics.

    questions: (query_id, question). Query tokens count once each. Only postings of the questions' tokens are counted and
    moved: the semi-join goes below the postings' own grouping. lengths: (doc_id, language, dl) of documents with a token; if
    they aren't given they are summed over all postings. Statistics per language are a few rows.
    """
    check_bm25(k1, b, variant)
    asked = questions.select("query_id", F.explode(tokens(F.col("question"))).alias("lexeme")).distinct()
    lengths = indexing.lengths(postings) if lengths is None else lengths
    met = postings.join(asked.select("lexeme").distinct(), "lexeme", "left_semi")
    hits = met.join(asked, "lexeme").join(indexing.document_frequency(met), ["language", "lexeme"])
    hits = hits.join(lengths, ["doc_id", "language"]).join(indexing.statistics(lengths), "language")
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(idf(variant, F.col("n").cast("double"), F.col("df").cast("double")) * weight).alias("score"))


def asked_lexemes(questions: DataFrame) -> DataFrame:
    """(query_id, korean, lexeme): each question's distinct lexemes by either plan, for documents of either kind."""
    both = questions.select("query_id", *(lexeme_counts(F.col("question"), F.lit(c)).alias(c) for c in ("en", "ko")))
    named = lambda c: F.transform(c, lambda t: F.struct(F.lit(c == "ko").alias("korean"), t["lexeme"].alias("lexeme")))
    # an inner explode would put a filter below the functions, which would then run twice
    told = both.select("query_id", F.explode_outer(F.concat(named("en"), named("ko"))).alias("t")).where("t IS NOT NULL")
    return told.select("query_id", "t.korean", "t.lexeme")


#: Asked lexemes that are told to all tasks, at most: some 16 MB of hashes. More are joined by a shuffle.
FEW_ASKED = 500_000


def having(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose lexeme is asked for, with few others that share its hash. Asked lexemes are counted first: a set that isn't
    large goes to all tasks, so that rows nobody asks for are not moved."""
    wanted = asked.select(F.xxhash64("lexeme").alias("asked_hash")).distinct()
    few = wanted.limit(FEW_ASKED + 1).count() <= FEW_ASKED
    return rows.join(F.broadcast(wanted) if few else wanted, F.xxhash64("lexeme") == F.col("asked_hash"), "left_semi")


def bm25_index(questions: DataFrame, index: DataFrame, keys: list[str], k1: float = 1.2, b: float = 0.75, variant: str = "lucene") -> DataFrame:
    """(query_id, keys, score) of the chunks of a written index that have a lexeme of the question, by their language's statistics.

    A question is read by the plan of each chunk's language, and its lexemes count once each. Only asked postings are counted
    and moved; a chunk's length travels with its postings, so no lengths are joined. Chunks without a lexeme count in no
    statistic.
    """
    check_bm25(k1, b, variant)
    asked = asked_lexemes(questions)
    rows = indexing.postings_of(index, keys).withColumn("korean", F.col("language").eqNullSafe("ko"))
    met = having(rows, asked)
    df = met.groupBy(F.col("language").alias("of"), F.col("lexeme").alias("word")).agg(F.count(F.lit(1)).alias("df"))
    stats = indexing.statistics(index.where("dl > 0")).withColumnRenamed("language", "in")
    hits = met.join(df, F.col("language").eqNullSafe(F.col("of")) & (F.col("lexeme") == F.col("word"))).join(stats, F.col("language").eqNullSafe(F.col("in"))).join(asked, ["korean", "lexeme"])
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", *keys).agg(F.sum(idf(variant, F.col("n").cast("double"), F.col("df").cast("double")) * weight).alias("score"))


def _best(weights: pa.Table, keys: list[str], k: int, k1: float, b: float, places: int):
    """The k best chunks of each question among a task's rows, by rounded score and then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexemes = pc.unique(weights["lexeme"].combine_chunks())
        queries = pc.unique(weights["query_id"].combine_chunks())
        languages = pc.unique(weights["language"].combine_chunks())
        code = lambda values, known: pc.index_in(values, known).to_numpy(zero_copy_only=False)
        # the questions of each (language, lexeme) with their weights, one after another
        word = code(weights["language"].combine_chunks(), languages) * len(lexemes) + code(weights["lexeme"].combine_chunks(), lexemes)
        order = np.argsort(word, kind="stable")
        query, idf_of = code(weights["query_id"].combine_chunks(), queries)[order], weights["idf"].to_numpy()[order]
        ends = np.searchsorted(word[order], np.arange(len(languages) * len(lexemes) + 1))
        avgdl = np.zeros(len(languages))
        avgdl[code(weights["language"].combine_chunks(), languages)] = weights["avgdl"].to_numpy()
        least, held = np.full(len(queries), -np.inf), []

        def pruned() -> pa.Table:
            rows = pa.concat_tables(held).sort_by([("query_id", "ascending"), ("score", "descending"), *((c, "ascending") for c in keys)])
            q = code(rows["query_id"].combine_chunks(), queries)
            begin = np.flatnonzero(np.diff(q, prepend=-1))
            nth = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
            last = nth == k - 1
            least[q[last]] = rows["score"].to_numpy()[last]
            return rows.filter(pa.array(nth < k))

        for batch in batches:
            of = batch.column("terms")
            sizes = of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = of.flatten()
            row, found = np.repeat(np.arange(batch.num_rows), sizes), pc.index_in(terms.field("lexeme"), lexemes)
            spoken = pc.index_in(batch.column("language"), languages).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = found.is_valid().to_numpy(zero_copy_only=False) & (spoken[row] >= 0)
            row, lang = row[hit], spoken[row[hit]]
            at = lang * len(lexemes) + found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[hit]
            tf, dl = terms.field("tf").to_numpy(zero_copy_only=False)[hit], batch.column("dl").to_numpy()[row]
            worth = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl[lang]))
            n = ends[at + 1] - ends[at]
            asked = np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, back = np.unique(np.repeat(row, n) * len(queries) + query[asked], return_inverse=True)
            score = np.bincount(back, np.repeat(worth, n) * idf_of[asked], len(pair))
            score = np.floor(score * 10**places + 0.5) / 10**places
            keep = score >= least[pair % len(queries)]
            pair, score = pair[keep], score[keep]
            rows = batch.select(keys).take(pa.array(pair // len(queries)))
            held.append(pa.table([queries.take(pa.array(pair % len(queries))), *rows.columns, pa.array(score)], names=["query_id", *keys, "score"]))
            held[:] = [pruned()]
        for t in held:
            yield from t.to_batches()

    return run


def bm25_best(questions: DataFrame, index: DataFrame, keys: list[str], k: int, k1: float = 1.2, b: float = 0.75, variant: str = "lucene", places: int = 6) -> DataFrame:
    """(query_id, keys, score, rank): the k best chunks of each question by bm25_index, scores rounded to `places`, ties by key.

    Nearly every chunk shares some lexeme with a long question, so each task scores its chunks, whose terms stand in one row, and
    passes on its own k best of each question only, which hold the best of all. The weights of asked lexemes, one for each question
    and language, are counted before they go to the tasks; more than FEW_ASKED are joined by shuffles instead.
    """
    check_bm25(k1, b, variant)
    asked = asked_lexemes(questions)
    if asked.limit(FEW_ASKED + 1).count() > FEW_ASKED:
        scored = bm25_index(questions, index, keys, k1, b, variant)
        return top_k(scored.withColumn("score", F.round("score", places)), k, *keys)
    rows = having(indexing.postings_of(index, keys), asked).withColumn("korean", F.col("language").eqNullSafe("ko"))
    df = rows.groupBy("language", "korean", "lexeme").agg(F.count(F.lit(1)).alias("df"))
    stats = indexing.statistics(index.where("dl > 0")).withColumnRenamed("language", "in")
    known = df.join(stats, F.col("language").eqNullSafe(F.col("in"))).join(asked, ["korean", "lexeme"])
    weights = known.select("query_id", F.coalesce("language", F.lit("")).alias("language"), "lexeme", idf(variant, F.col("n").cast("double"), F.col("df").cast("double")).alias("idf"), F.col("avgdl").cast("double").alias("avgdl")).toArrow()
    kinds = dict(index.dtypes) | {"query_id": dict(questions.dtypes)["query_id"]}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("query_id", *keys)), "score double"])
    told = index.select(*keys, F.coalesce("language", F.lit("")).alias("language"), "dl", "terms")
    if not weights.num_rows:
        return top_k(index.sparkSession.createDataFrame([], schema), k, *keys)
    return top_k(told.mapInArrow(_best(weights, keys, k, k1, b, places), schema), k, *keys)


def answered(questions: DataFrame, hits: DataFrame, state: DataFrame, strict: bool = True) -> DataFrame:
    """The hits of each question with the index's state, which has one row: a question without hits keeps a row of nulls.

    State and hits are read by one plan, so that neither an index that isn't ready nor one that was rebuilt meanwhile can turn into
    an empty success. With `strict` an index that isn't ready raises an error when the result is read, hits or not.
    """
    told = questions.select("query_id").distinct().crossJoin(F.broadcast(state.limit(1))).join(hits, "query_id", "left")
    if not strict:
        return told
    lacks = F.concat_ws(" ", F.lit("the index is not ready:"), *(x for c in ("n_chunks", "n_missing", "n_stale", "n_orphans") for x in (F.lit(c), F.col(c).cast("string"))))
    return told.where(F.when(F.col("ready"), True).otherwise(F.raise_error(lacks).cast("boolean")))


#: Queries and vectors that meet in one cell, about; vectors that a cell scores at once.
CELL_QUERIES, CELL_VECTORS, SLICE = 16_384, 32_768, 256


def rounded(x: np.ndarray, places: int | None) -> np.ndarray:
    """Halves away from zero, as SQL rounds; no negative zeros."""
    return x if places is None else np.copysign(np.floor(np.abs(x) * 10**places + 0.5) / 10**places, x) + 0.0


def _nearest(k: int, places: int | None, schema: pa.Schema):
    """The k best vectors of each query of a cell, by rounded score and then by id; a NaN is beyond all scores."""
    unit = 0.0 if places is None else 10.0**-places

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        vectors = vectors.take(pc.sort_indices(vectors, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))

        def units(of: pa.ChunkedArray) -> np.ndarray:
            m = pc.list_flatten(of).to_numpy().astype(np.float64).reshape(len(of), -1)
            return m / np.sqrt((m * m).sum(axis=1))[:, None]

        with np.errstate(invalid="ignore", over="ignore"):
            asked = units(queries["q"])
            least, held, new = np.full(len(asked), -np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

            def pruned() -> tuple[np.ndarray, ...]:
                q, v, s = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                begin = np.flatnonzero(np.diff(q, prepend=-1))
                nth = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
                least[q[nth == k - 1]] = s[nth == k - 1]
                return q[nth < k], v[nth < k], s[nth < k]

            for at in range(0, vectors.num_rows, SLICE):
                score = asked @ units(vectors["embedding"].slice(at, SLICE)).T
                score[np.isnan(score)] = np.inf
                # what came before has lower ids, so a score that only ties with the k-th is no better; unrounded, half a unit is less
                low = least + 0.4 * unit
                if score.shape[1] > k and not np.isfinite(low).all():
                    low = np.where(np.isfinite(low), low, np.partition(score, -k, axis=1)[:, -k] - unit)
                q, v = np.nonzero(score >= low[:, None])
                held.append((q, v + at, rounded(score[q, v], places)))
                new += len(q)
                if new > len(asked) * k // 2:
                    held[:], new = [pruned()], 0
            q, v, s = pruned()
        return pa.table([queries["query_id"].take(pa.array(q)), vectors["vec_id"].take(pa.array(v)), pa.array(np.where(np.isinf(s), np.nan, s))], schema=schema)

    return run


def cosine_search(queries: DataFrame, vectors: DataFrame, k: int, places: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of each query by exact cosine, ties by id.

    queries (query_id, embedding) is a stated query set held against all vectors. Scores are rounded to `places`, if given, before
    they are ranked, so that what ties then is ranked by id. Either side is dealt by its ids, and each deal of queries meets each
    deal of vectors in a cell, whose size doesn't grow: it multiplies matrices and passes on its own k best of each query, which
    hold the best of all. Work is the product of both sides' sizes, as every pair is scored.
    """
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(queries.select("query_id").dtypes) | dict(vectors.select("vec_id").dtypes)
    unit = lambda df: df.withColumn("dim", F.size("embedding")).where(norm(F.col("embedding")) > 0)
    asked_deals, vector_deals = 1 + queries.count() // CELL_QUERIES, 1 + vectors.count() // CELL_VECTORS
    deal = lambda c, deals: F.pmod(F.xxhash64(c), F.lit(deals))
    each = lambda deals: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long")))
    q = unit(queries).select("query_id", F.col("embedding").alias("q"), "dim", deal("query_id", asked_deals).alias("a")).withColumn("b", each(vector_deals))
    v = unit(vectors).select("vec_id", "embedding", "dim", deal("vec_id", vector_deals).alias("b")).withColumn("a", each(asked_deals))
    cells = [df.repartition(n, "dim", "a", "b").groupBy("dim", "a", "b") for df in (q, v)]
    told = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double"
    schema = to_arrow_schema(queries.select("query_id").schema.add("vec_id", vectors.schema["vec_id"].dataType).add("score", "double"))
    return top_k(cells[0].cogroup(cells[1]).applyInArrow(_nearest(k, places, schema), told), k, "vec_id")


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best rows of each query by score, then by the tie columns ascending; adds rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *[F.col(t).asc() for t in ties])
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lanes: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, lane, doc_id, rank): (query_id, doc_id, score, rank).

    A document counts once in a lane, by its first rank. If lanes have a column identity, one document with two of them raises
    an error.
    """
    if "identity" in lanes.columns:
        clash = F.raise_error(F.concat(F.lit("one document, two identities: "), F.col("doc_id").cast("string"))).cast("boolean")
        two = lanes.groupBy("doc_id").agg(F.min("identity").alias("low"), F.max("identity").alias("high")).where(F.when(F.col("low") != F.col("high"), clash).otherwise(F.lit(True)))
        lanes = lanes.join(two.select("doc_id"), "doc_id")
    first = lanes.groupBy("query_id", "lane", "doc_id").agg(F.min("rank").alias("rank"))
    fused = first.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("score"))
    return top_k(fused, k, "doc_id")


def component_ranks(lanes: DataFrame) -> DataFrame:
    """(query_id, doc_id, lanes): in which lanes a document ranks where."""
    return lanes.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("lane", "rank"))).alias("lanes"))


def first_of(hits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in this order."""
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth = 1").drop("nth")


def text_owner(hits: DataFrame) -> DataFrame:
    """Adds owner: the best-ranked hit of the query whose text, its header included if there is one, is the same but for white
    space."""
    from lodestone.functions.text import collapse

    text = F.concat_ws("\n\n", "header", "body") if "header" in hits.columns else F.col("body")
    same = Window.partitionBy("query_id", collapse(text)).orderBy("rank")
    return hits.withColumn("owner", F.first("doc_id").over(same))


def prefer_documents(hits: DataFrame, per_document: int) -> DataFrame:
    """Reranks a query's hits: first those among their document's best `per_document`, then the others, each in order."""
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    held = hits.withColumn("later", nth > per_document)
    return held.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("later", "rank"))).drop("later")


def fill(hits: DataFrame, k: int, budget: int) -> DataFrame:
    """(query_id, taken): hits in order while slots and budget last; one that is too large is passed over, later ones may fit.

    hits: (query_id, rank, doc_id, cost). What is taken depends on what was, so it is a fold over a query's ranked hits.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "cost"))).alias("hits"))
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, hit: Column) -> Column:
        fits = (F.size(acc["taken"]) < k) & (hit["cost"] <= acc["left"])
        return F.struct(F.when(fits, acc["left"] - hit["cost"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["taken"], F.array(hit["doc_id"]))).otherwise(acc["taken"]).alias("taken"))

    return listed.select("query_id", F.aggregate("hits", zero, step, lambda acc: acc["taken"]).alias("taken"))


def transitions(before: DataFrame, after: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, change, delta) of two rankings; a missing rank is a miss.

    asked: (query_id, doc_id) pairs that are told of besides; those that neither ranking has are stable misses.
    """
    both = before.select("query_id", "doc_id", F.col("rank").alias("was")).join(after.select("query_id", "doc_id", F.col("rank").alias("now")), ["query_id", "doc_id"], "full")
    if asked is not None:
        both = both.join(asked.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "full")
    change = F.when(F.col("was").isNull() & F.col("now").isNull(), "stable_miss").when(F.col("was").isNull(), "miss_to_hit").when(F.col("now").isNull(), "hit_to_miss").otherwise("stable_hit")
    return both.select("query_id", "doc_id", change.alias("change"), (F.col("was") - F.col("now")).alias("delta"))


def cover_density(questions: DataFrame, positions: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of documents that have all of a question's tokens, by how densely their covers hold them.

    positions: (doc_id, lexeme, place), places from 1. A cover is a shortest stretch that holds every query token; it counts
    one over its excess, the places in it beyond one for each token, plus one. The sum is divided by the covers' mean
    distance and by one plus the log of the document's length. A cover ends at a matched place and begins at the earliest of
    the tokens' last places; windows over the matched places give those, without any pairing of places.

    A question's documents are looked for among those that have its rarest token, so that common tokens' places are met only
    for documents that have all tokens.
    """
    terms = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("lexeme"))
    n = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = positions.join(F.broadcast(terms.select("lexeme").distinct()), "lexeme", "left_semi")
    held = asked.groupBy("doc_id", "lexeme").agg(F.array_sort(F.collect_list("place")).alias("places"))
    frequency = held.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
    rarest = terms.join(frequency, "lexeme", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "lexeme"))["lexeme"].alias("lexeme"))
    maybe = held.select("doc_id", "lexeme").join(rarest, "lexeme").select("query_id", "doc_id")
    firsts = held.select("doc_id", "lexeme", F.get("places", F.lit(0)).alias("first"))
    # before all tokens have been seen, nothing is covered
    full = maybe.join(terms, "query_id").join(firsts, ["doc_id", "lexeme"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("held"), F.max("first").alias("seen"))
    full = full.join(n, "query_id").where("held = n").drop("held")
    hits = full.join(terms, "query_id").join(held, ["doc_id", "lexeme"]).select("query_id", "doc_id", "n", "seen", "places", F.posexplode("places").alias("i", "place"))
    hits = hits.withColumn("later", F.get("places", F.col("i") + 1))
    # a token's place is its last one for ends in [place, later): a cover begins at the least place whose later is beyond its end
    ends = F.struct(F.col("place").alias("at"), F.col("place").alias("e"), F.lit(None).cast("int").alias("s"))
    begins = F.struct(F.col("later").alias("at"), F.lit(None).cast("int").alias("e"), F.col("place").alias("s"))
    events = hits.select("query_id", "doc_id", "n", "seen", F.explode(F.array(ends, begins)).alias("x")).select("query_id", "doc_id", "n", "seen", "x.*")
    beyond = Window.partitionBy("query_id", "doc_id").orderBy(F.col("at").desc_nulls_first(), F.col("e").desc_nulls_last())
    spans = events.withColumn("s", F.min("s").over(beyond.rowsBetween(Window.unboundedPreceding, 0))).where("e >= seen")
    ordered = Window.partitionBy("query_id", "doc_id").orderBy("e")
    # of stretches with one begin, the first to end is the shortest
    covers = spans.withColumn("last_s", F.lag("s").over(ordered)).where("last_s IS NULL OR last_s < s")
    covers = covers.withColumn("gap", (F.col("s") + F.col("e")) / 2 - F.lag((F.col("s") + F.col("e")) / 2).over(ordered))
    summed = covers.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.col("e") - F.col("s") + 2 - F.col("n"))).alias("weight"), F.avg(F.when(F.col("gap").isNotNull(), F.greatest("gap", F.lit(1.0)))).alias("distance"))
    lengths = positions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))
    return summed.join(lengths, "doc_id").select("query_id", "doc_id", (F.col("weight") / F.coalesce("distance", F.lit(1.0)) / (1 + F.ln("dl"))).alias("score"))
