"""Queries over whole inputs: what lies behind a prefix, a filter or a cut must be in the results."""

import itertools
import math
import random

from lodestone.plans.more_queries import QUERIES


def written(spark, tmp_path, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_ordered_distinct_reads_whole_texts(spark, tmp_path):
    words = [f"w{k}" for k in range(400)]
    data = [(1, " ".join(words + words[::-1])), (2, "!" * 400 + "B a b"), (3, "?"), (4, None)]
    got = QUERIES["ref_ordered_distinct"](spark, written(spark, tmp_path, documents=(data, "doc_id long, text string")))
    assert sorted(tuple(r[c] for c in ("doc_id", "words", "n")) for r in got.collect()) == [(1, " ".join(words), 400), (2, "b a", 2), (3, "", 0), (4, "", 0)]


def test_overlap_join_reads_all_parts(spark, tmp_path):
    parts = [(k, k % 50 + 1) for k in range(1, 301)]
    d = written(spark, tmp_path, part=(parts, "p_partkey long, p_size long"), supplier=([(k,) for k in range(1, 701)], "s_suppkey long"))
    a = [(k, size * 10, size * 10 + k % 90) for k, size in parts]
    b = [(k, k % 500, k % 500 + 7) for k in range(1, 701)]
    want = sorted((x, y) for x, s, e in a for y, t, f in b if s < e and s < f and t < e)
    got = sorted((r.a_id, r.b_id) for r in QUERIES["ref_overlap_join"](spark, d).collect())
    assert got == want and {x % 5 for x, _ in got} == set(range(5))


def cover_densities(question, docs):
    """Covers by brute force: stretches that hold every token of the question and no shorter such stretch."""
    asked, out = set(question.split()), {}
    for k, t in docs:
        w = t.split()
        held = [(s, e) for s in range(1, len(w) + 1) for e in range(s, len(w) + 1) if asked <= set(w[s - 1 : e])]
        covers = sorted(c for c in held if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in held))
        if covers:
            mids = [(s + e) / 2 for s, e in covers]
            gaps = [max(1.0, b - a) for a, b in itertools.pairwise(mids)]
            out[k] = sum(1 / (e - s + 2 - len(asked)) for s, e in covers) / (sum(gaps) / len(gaps) if gaps else 1) / (1 + math.log(len(w)))
    return out


def test_cover_density_asks_for_whole_questions(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40)))) for k in range(60)]
    asked = [(1, "a b c d"), (2, "h"), (3, "e f"), (4, "a b z"), (5, "a b c d e f g h")]
    d = written(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"))
    want = {}
    for q, question in asked:
        best = sorted(((-round(s, 9), k) for k, s in cover_densities(question, docs).items()))[:10]
        want |= {(q, k): (-s, n) for n, (s, k) in enumerate(best, 1)}
    got = {(r.query_id, r.doc_id): (round(r.score, 9), r["rank"]) for r in QUERIES["ref_cover_density"](spark, d).collect()}
    assert got == want and {q for q, _ in got} == {1, 2, 3, 5}


def test_cosine_search_ranks_all_that_tie_after_rounding(spark, tmp_path):
    rng = random.Random(7)
    one = [rng.uniform(-1, 1) for _ in range(24)]
    scaled = [(k, [x * (1 + (61 - k) * 0.013) * (1 + rng.uniform(-1, 1) * 1e-12) for x in one]) for k in range(61)]
    d = written(spark, tmp_path, embeddings=(scaled, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in QUERIES["ref_cosine_search"](spark, d).collect()}
    assert got == {(q, n): (n - 1, 1.0) for q in (0, 20, 40, 60) for n in range(1, 11)}
