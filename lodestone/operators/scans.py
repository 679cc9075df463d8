"""Questions ranked against whole texts in scans that move no token."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.passages import text_batches
from lodestone.functions.text import tokens
from lodestone.streaming.streams import shared_folder

from . import ranking

#: Pairs of a text's asked tokens and questions, and scores, that a worker holds at once, about.
PAIRS, SCORES = 1 << 20, 1 << 22
#: Ids that several rows share and that are told to all tasks, at most.
FEW_IDS = 500_000
#: What stands between tokens: T.tokens from the other side, by the expression engine that DuckDB has too.
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"


def written(df: DataFrame, label: str) -> DataFrame:
    """A small result, written to the shared folder, so that what is made of it doesn't scan the texts again."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/{label}_{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _codes(values: pa.ChunkedArray | pa.Array, known: pa.Array) -> np.ndarray:
    """Places among the known values, -1 for others."""
    found = pc.index_in(values, known).fill_null(-1)
    return (found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found).to_numpy(zero_copy_only=False).astype(np.int64)


def _met(lowered: pa.Array, lexemes: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, code, tf) of the lexemes that lower-case texts hold, in order, and each text's number of tokens."""
    words = pc.split_pattern_regex(lowered, BETWEEN)
    flat = words.flatten()
    row = np.repeat(np.arange(len(lowered)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    dl = np.bincount(row[pc.not_equal(flat, "").to_numpy(zero_copy_only=False)], minlength=len(lowered))
    code = _codes(flat, lexemes)
    key, tf = np.unique(row[code >= 0] * len(lexemes) + code[code >= 0], return_counts=True)
    return key // len(lexemes), key % len(lexemes), tf, dl


def _counts(lexemes: pa.Array):
    """A batch's (language, code, n, dl): of each language and lexeme its texts, and at code -1 the texts with a token and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, _, dl = _met(batch.column("text"), lexemes)
            known = batch.column("language").dictionary_encode(null_encoding="encode")
            lang = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key, n = np.unique(lang[row] * len(lexemes) + code, return_counts=True)
            some, texts = np.unique(lang[dl > 0], return_counts=True)
            of = np.concatenate([key // len(lexemes), some])
            columns = np.concatenate([key % len(lexemes), np.full(len(some), -1)]), np.concatenate([n, texts]), np.concatenate([np.zeros(len(n), np.int64), np.bincount(lang, dl, len(known.dictionary)).astype(np.int64)[some]])
            yield pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(of)), *(pa.array(c.astype(np.int64)) for c in columns)], names=["language", "code", "n", "dl"])

    return run


def _bests(asked: pa.Table, lexemes: pa.Array, stats: pa.Table, lanes: dict[str, str], k: int | None, k1: float, b: float, places: int, schema: pa.Schema):
    """(query_id, lane, doc_id, score): a task's k best texts of each question by each lane, by rounded score and then by id; without
    k all of them, unrounded."""
    queries = pc.unique(asked["query_id"].combine_chunks())
    word, query = _codes(asked["lexeme"], lexemes), _codes(asked["query_id"], queries)
    query, ends = query[np.argsort(word, kind="stable")], np.searchsorted(np.sort(word), np.arange(len(lexemes) + 1))
    stats = stats.filter(pc.is_valid(stats["language"]))
    languages = pc.unique(stats["language"].combine_chunks())
    lang, code, n, dl = _codes(stats["language"], languages), *(stats[c].to_numpy() for c in ("code", "n", "dl"))
    texts, tokens_of = np.zeros(len(languages)), np.zeros(len(languages))
    texts[lang[code < 0]], tokens_of[lang[code < 0]] = n[code < 0], dl[code < 0]
    key = lang[code >= 0] * len(lexemes) + code[code >= 0]
    order = np.argsort(key)
    key, df = key[order], n[code >= 0][order].astype(float)
    ratio = (texts[key // max(1, len(lexemes))] - df + 0.5) / (df + 0.5)
    idf = {"lucene": np.log1p(ratio), "robertson": np.log(ratio)}
    del asked, stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {lane: np.full(len(queries), -np.inf) for lane in lanes}
        held, new = {lane: [] for lane in lanes}, dict.fromkeys(lanes, 0)

        def pruned(lane: str) -> pa.Table:
            rows = pa.concat_tables(held[lane]).sort_by([("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
            q = rows["q"].to_numpy()
            begin = np.flatnonzero(np.diff(q, prepend=-1))
            nth = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
            least[lane][q[nth == k - 1]] = rows["score"].to_numpy()[nth == k - 1]
            return rows.filter(pa.array(nth < k))

        def told(lane: str, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [queries.take(rows["q"].combine_chunks()), pa.array([lane] * len(rows), pa.string()), rows["doc_id"], rows["score"]]
            yield from pa.table(columns, schema=schema).to_batches()

        for batch in batches:
            row, code, tf, dl = _met(batch.column("text"), lexemes)
            spoken = _codes(batch.column("language"), languages)
            worth = {}
            if len(key):
                at = spoken[row] * len(lexemes) + code
                at = np.minimum(np.searchsorted(key, at), len(key) - 1)
                mean = (tokens_of / np.maximum(texts, 1))[np.maximum(spoken[row], 0)]
                full = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / np.where(mean > 0, mean, 1)))
                worth = {lane: idf[how][at] * full for lane, how in lanes.items() if how != "overlap"}
            n = ends[code + 1] - ends[code]
            upto = np.cumsum(n)
            # so many texts at once that neither their pairs with questions nor their scores are many
            first, step = 0, max(1, SCORES // len(queries))
            while first < len(row):
                last = min(np.searchsorted(row, row[first] + step), np.searchsorted(upto, upto[first] - n[first] + PAIRS, "right"))
                last = max(np.searchsorted(row, row[last]) if last < len(row) else last, np.searchsorted(row, row[first], "right"))
                m, base = n[first:last], row[first]
                size = row[last - 1] - base + 1
                pair = np.repeat((row[first:last] - base) * len(queries), m) + query[np.repeat(ends[code[first:last]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                shared = np.bincount(pair, minlength=size * len(queries))
                for lane, how in lanes.items():
                    score = shared.astype(float) if how == "overlap" else np.bincount(pair, np.repeat(worth[lane][first:last], m), size * len(queries)) if worth else np.zeros(len(shared))
                    hit = (shared > 0).reshape(size, -1)
                    if how != "overlap":
                        hit &= (spoken[base : base + size] >= 0)[:, None]
                    score = score.reshape(size, -1)
                    if k is not None:
                        hit &= score >= (least[lane] - 10.0**-places)[None, :]
                    r, q = np.nonzero(hit)
                    score = score[r, q] if k is None else ranking.rounded(score[r, q], places)
                    keep = score >= least[lane][q]
                    rows = pa.table({"q": q[keep], "doc_id": batch.column("doc_id").take(pa.array(r[keep] + base)), "score": score[keep]})
                    if k is None:
                        yield from told(lane, rows)
                        continue
                    held[lane].append(rows)
                    new[lane] += len(rows)
                    if new[lane] > max(len(queries) * k, 1_024):
                        held[lane], new[lane] = [pruned(lane)], 0
                first = last
        for lane in lanes:
            if k is not None and held[lane]:
                yield from told(lane, pruned(lane))

    return run


def repeated(texts: DataFrame) -> DataFrame | None:
    """(doc_id) of ids that are null or that several rows have, if there are any; ids alone are shuffled."""
    ids = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again"))
    n = ids.limit(FEW_IDS + 1).count()
    return None if not n else F.broadcast(ids) if n <= FEW_IDS else ids


def ranked(questions: DataFrame, texts: DataFrame, lanes: dict[str, str], k: int, k1: float = 1.2, b: float = 0.75, places: int = 6) -> DataFrame:
    """(query_id, lane, doc_id, score, rank): the k best documents of each question by each lane, ties by id.

    texts: (doc_id, language, text); rows of one id and language are one document. lanes: "lucene" or "robertson", which is
    ranking.bm25 of whole texts rounded to `places`, or "overlap", the number of the question's tokens that a document has.

    Nearly every document shares some token with a long question, so neither tokens nor pairs are shuffled. One scan counts in how
    many documents of each language asked tokens are, and the documents' tokens; these counts go to all tasks. A second scan scores
    each document as a whole, and a task passes on its own k best of each question, which hold the best of all. Texts of ids that
    repeat are put together first. More than FEW_ASKED asked tokens are joined by shuffles instead. The result is written once.
    """
    ranking.check_bm25(k1, b, "lucene")
    spark = texts.sparkSession
    asked = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("lexeme")).distinct()
    kinds = dict(questions.dtypes) | dict(texts.dtypes)
    if asked.limit(ranking.FEW_ASKED + 1).count() > ranking.FEW_ASKED:
        return written(_shuffled(questions, asked, texts, lanes, k, k1, b, places), "ranked")
    text_batches(spark)
    parts = questions.select("query_id", F.lower("question").alias("text")).toArrow()
    words = pc.split_pattern_regex(parts["text"].combine_chunks(), BETWEEN)
    asked = pa.table({"query_id": parts["query_id"].combine_chunks().take(pc.list_parent_indices(words)), "lexeme": words.flatten()}).group_by(["query_id", "lexeme"]).aggregate([])
    asked = asked.filter(pc.not_equal(asked["lexeme"], ""))
    lexemes = pc.unique(asked["lexeme"].combine_chunks())
    told = f"query_id {kinds['query_id']}, lane string, doc_id {kinds['doc_id']}, score double"
    if not len(lexemes):
        return ranking.top_k(spark.createDataFrame([], told), k, "doc_id")

    plain = texts.select("doc_id", "language", F.lower("text").alias("text"))
    once, again = plain, repeated(texts)
    whole = [(once, k)]
    if again is not None:
        once = plain.where("doc_id IS NOT NULL").join(again, F.col("doc_id") == F.col("again"), "left_anti")
        more = plain.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
        whole = [(once, k), (more.groupBy("doc_id", "language").agg(F.concat_ws("\n", F.collect_list("text")).alias("text")), None)]
    counts = [df.select("language", "text").mapInArrow(_counts(lexemes), f"language {kinds['language']}, code long, n long, dl long") for df, _ in whole]
    counts = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    stats = counts.groupBy("language", "code").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).toArrow()
    schema = to_arrow_schema(spark.createDataFrame([], told).schema)
    best = [df.mapInArrow(_bests(asked, lexemes, stats, lanes, most, k1, b, places, schema), told) for df, most in whole]
    if len(best) > 1:
        some = best[1].groupBy("query_id", "lane", "doc_id").agg(F.round(F.sum("score"), places).alias("score"))
        best[0] = best[0].unionByName(some.where(F.col("doc_id").isNotNull() | F.col("lane").isin([lane for lane, how in lanes.items() if how == "overlap"])))
    return written(_first(best[0], k), "ranked")


def _first(scored: DataFrame, k: int) -> DataFrame:
    """ranking.top_k within each lane."""
    one = ranking.top_k(scored.withColumn("query", F.col("query_id")).withColumn("query_id", F.struct("query_id", "lane")), k, "doc_id")
    return one.select(F.col("query").alias("query_id"), "lane", "doc_id", "score", "rank")


def _shuffled(questions: DataFrame, asked: DataFrame, texts: DataFrame, lanes: dict[str, str], k: int, k1: float, b: float, places: int) -> DataFrame:
    """ranked, by joins of postings."""
    postings = texts.select("doc_id", "language", F.explode(tokens(F.col("text"))).alias("lexeme")).groupBy("doc_id", "language", "lexeme").agg(F.count(F.lit(1)).alias("tf"))
    out = None
    for lane, how in lanes.items():
        scored = postings.join(asked, "lexeme").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("score")) if how == "overlap" else ranking.bm25(questions, postings, k1, b, how).withColumn("score", F.round("score", places))
        scored = scored.select("query_id", F.lit(lane).alias("lane"), "doc_id", "score")
        out = scored if out is None else out.unionByName(scored)
    return _first(out, k)
