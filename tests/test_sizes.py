"""What grows with the tables: no group in one task, no pairs in a shuffle, and the same results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import passages
from lodestone.operators import grids, parsing, ranking, scans
from lodestone.plans.filing_queries import QUERIES


def test_overlapping_deals_one_block_to_several_tasks(spark):
    n = 5 * parsing.BLOCK_RANGES
    a = spark.range(n).select(F.col("id").alias("a_id"), (F.col("id") % 60).alias("a_start"), (F.col("id") % 60 + F.col("id") % 4).alias("a_end"))
    ranges = [(None, 3, 5), (None, 3, 5), (1, 3, 5), (2, 3, 5), (2, 3, 5), (3, 59, 64), (4, 60, 70), (5, 7, 7), (6, -70, 200)]
    got = parsing.overlapping(a, spark.createDataFrame(ranges, "b_id int, b_start long, b_end long")).withColumn("task", F.spark_partition_id())
    want = {}
    for k in range(n):
        s, e = k % 60, k % 60 + k % 4
        for i, t, f in ranges:
            if s < e and t < f and s < f and t < e:
                want[i] = want.get(i, 0) + 1
    told = got.groupBy("b_id").agg(F.count("a_id").alias("n"), F.sum("a_id").alias("sum"), F.count_distinct("task").alias("tasks")).collect()
    assert {r.b_id: r.n for r in told} == want and all(r.tasks > 1 for r in told if r.b_id != 4)


def test_cosine_search_by_cells_ranks_as_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for name, value in (("CELL_QUERIES", 7), ("CELL_VECTORS", 40), ("SLICE", 16)):
        monkeypatch.setattr(ranking, name, value)
    m = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties, some zero vectors
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(1000 + k, [1.0, float(k)]) for k in range(5)]
    v = spark.createDataFrame([*rows, (2000, None), (2001, [float("nan")] * 2)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 3 = 0 AND vec_id < 2000").withColumnRenamed("vec_id", "query_id")
    found = ranking.cosine_search(q, v, 5, 9)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "BroadcastHashJoin" not in plan
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    want = {}
    for a, x in rows:
        if a % 3 == 0 and any(x):
            near = [(-round(math.sumprod(x, y) / (math.hypot(*x) * math.hypot(*y)), 9), b) for b, y in rows if len(x) == len(y) and any(y)]
            near += [(-math.inf, 2001)] * (len(x) == 2)
            want |= {(a, n): (b, -s) for n, (s, b) in enumerate(sorted(near)[:5], 1)}
    assert {k: (b, math.inf if s != s else s) for k, (b, s) in got.items()} == {k: (b, s + 0.0) for k, (b, s) in want.items()}


SF = "/root/testdata/sf0.001"


def plan(name, spark):
    return QUERIES[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["ref_bm25_robertson", "ref_component_ranks", "ref_hybrid_fusion", "ref_grades", "ref_rank_transitions", "ref_budgeted_fill"])
def test_hits_come_from_scans_that_shuffle_no_token(spark, name):
    assert "regexp_extract_all" not in plan(name, spark)


def test_ranked_scans_equal_joins_of_postings(spark, monkeypatch):
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "été", "ñandú", "7", "한국", "delta"]
    said = lambda most: rng.choice((" ", "\n", "; ")).join(rng.choice(words) for _ in range(rng.randrange(most)))
    docs = [(k, rng.choice(("en", "de", None)), said(30)) for k in range(150)] + [(k % 9, rng.choice(("en", "de")), said(12)) for k in range(20)]
    docs += [(None, "en", " ".join(words)), (None, "de", "7 7"), (500, "en", None), (501, "de", "!?"), (502, None, "gamma delta")]
    asked = [(k, said(6)) for k in range(12)] + [(3, "delta alpha alpha"), (50, None), (51, "nowhere")]
    texts, questions = spark.createDataFrame(docs, "doc_id long, language string, text string").repartition(3), spark.createDataFrame(asked, "query_id int, question string")
    lanes = {"a": "lucene", "b": "robertson", "c": "overlap"}
    told = lambda: {(r.query_id, r.lane, r["rank"]): (r.doc_id, round(r.score, 6)) for r in scans.ranked(questions, texts, lanes, 6).collect()}
    got = told()
    for name, value in (("PAIRS", 9), ("SCORES", 40)):
        monkeypatch.setattr(scans, name, value)
    small = told()
    monkeypatch.setattr(scans, "FEW_IDS", 2)
    many = told()
    monkeypatch.setattr(ranking, "FEW_ASKED", 0)
    assert got == small == many == told() and {lane for _, lane, _ in got} == set(lanes)
    assert any(d is None for d, _ in got.values()) and len({d for d, _ in got.values() if d is not None and d < 9}) > 3


def test_passages_are_found_where_contains_finds_them(spark):
    rng = random.Random(3)
    said = lambda n: "".join(rng.choice("aabbcé한😀 ") for _ in range(n))
    docs = [(k, said(rng.randrange(400))) for k in range(80)] + [(80, None), (81, ""), (81, "한국어 abcabcabc"), (None, "xyz abcabcabc"), (82, "abcabca"), (83, "bc")]
    held = [docs[k][1][s : s + n] for k in range(0, 60, 3) for s, n in ((5, 12), (0, 60), (50, 3))]
    asked = [(k, p) for k, p in enumerate([*held, held[1], "", "a", "abcabcabc", "abcabcabcabc", None])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, passage string")
    found = passages.found(d, b)
    want = sorted(((i, k, t.find(p), t.find(p) + len(p)) for k, t in docs if t is not None for i, p in asked if p is not None and p in t), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and len(want) > 300
    assert "MapInArrow" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["ref_case_scores", "ref_suite_metrics", "ref_category_metrics"])
def test_gold_is_found_in_one_pass(spark, name):
    assert "regexp_extract_all" not in (told := plan(name, spark)) and "NestedLoop" not in told and "contains(" not in told


def test_grids_shuffle_a_tables_cells_once(spark):
    spans = "doc_id int, row_no int, cell_no int, text string, rowspan int, colspan int, align string, start_char long, end_char long"
    cells = [(1, 0, 0, "(단위 : 원)", 1, 2, None, 0, 9), (1, 1, 0, "Year\n", 1, 1, None, 10, 14), (1, 1, 1, "2024\n", 0, None, None, 15, 19), (1, 2, 0, "Sales", 1, 1, None, 20, None), (1, 2, 1, "5\n", 1, 5000, "x", 26, 27), (1, None, 0, "lost", 1, 1, None, 0, 1), (2, 0, 0, " ", 1, 1, None, 0, 1)]
    own, notes = grids.structured(spark.createDataFrame(cells, spans), ["doc_id"])
    for df in (own, notes):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.row_no, r.col, r.header, r.text, [tuple(s) for s in r.sources]) for r in own.collect()) == [
        (1, 0, True, "Year\n", [(10, 14)]), (1, 1, True, "2024\n", [(15, 19)]), (2, 0, False, "Sales", [(20, None)]), (2, 1, False, "5\n", [(26, 27)]),
    ]
    assert [(r.doc_id, [tuple(c) for c in r.captions]) for r in notes.collect()] == [(1, [("(단위 : 원)", 0, 9)])]
