from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import admin, evidence, snapshots, suites


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_twins(spark):
    schema = "case_id string, kind string, question string"
    a = spark.createDataFrame([("a", "x", "How much?"), ("b", "x", "Why?"), ("c", "x", "Who?"), ("e", "x", "1"), ("e", "x", "1")], schema)
    b = spark.createDataFrame([("a", "x", "얼마?"), ("b", None, "왜?"), ("c", "x", " who? "), ("d", "x", "?"), ("e", "x", "2")], schema)
    want = [("a", None), ("b", "kind"), ("c", "one question"), ("d", "first suite lacks it"), ("e", "repeated")]
    assert rows(suites.twins(a, b, ["kind"]), "case_id", "problem") == want
    # languages the wrong way round, and none of them right
    swapped = [("a", "Hangul in the first suite"), ("b", "kind"), ("c", "one question"), ("d", "second suite lacks it"), ("e", "repeated")]
    assert rows(suites.twins(b, a, ["kind"]), "case_id", "problem") == swapped
    other = a.where("case_id = 'a'").withColumn("question", F.lit("Combien ?"))
    assert rows(suites.twins(a.where("case_id = 'a'"), other, ["kind"]), "problem") == [("no Hangul in the second suite",)]
    assert rows(suites.twins(a.where("case_id = 'a'"), b.limit(0), ["kind"]), "case_id", "problem") == [("a", "second suite lacks it"), (None, "second suite is empty")]


def test_spans_are_verified_in_code_points(spark):
    sources = spark.createDataFrame([(1, "h", "삼성 100원 "), (2, "h", "x")], "doc_id long, sha256 string, text string")
    answers = spark.createDataFrame([(1, "h", 3, 7), (1, "h", 7, 8), (1, "h", 7, 9), (1, "h", 3, 3), (2, "g", 0, 1), (3, "h", 0, 1)], "doc_id long, sha256 string, start_char long, end_char long")
    want = [(1, 3, 3, "outside"), (1, 3, 7, None), (1, 7, 8, "blank"), (1, 7, 9, "outside"), (2, 0, 1, "other source"), (3, 0, 1, "no source")]
    assert rows(suites.verified_spans(answers, sources), "doc_id", "start_char", "end_char", "problem") == want


def test_provenance_and_gate(spark):
    cases = spark.createDataFrame([("a", "draft", 1), ("a", "draft", 0), ("a", "draft", None)], "suite string, status string, answers int")
    assert rows(suites.provenance(cases), "cases", "positive", "absent", "status") == [(3, 1, 2, "draft")]
    with pytest.raises(Exception, match="several statuses"):
        suites.provenance(cases.union(spark.sql("SELECT 'a', null, 1"))).collect()
    with pytest.raises(Exception, match="no case with answers"):
        suites.provenance(cases.where("answers = 0")).collect()
    arms = spark.createDataFrame([(True, None), (True, True)], "parity boolean, regression boolean")
    assert rows(suites.gate(arms), "passed", "first_runs") == [(True, 1)]
    assert rows(suites.gate(arms, True), "passed") == [(False,)]
    assert rows(suites.gate(arms.where("regression IS NULL")), "regression", "passed") == [(None, True)]
    assert rows(suites.gate(arms.union(spark.sql("SELECT null, true"))), "passed") == [(False,)]


def test_arms_and_names(spark):
    arms = spark.createDataFrame([(512, "hybrid", "bm25", "d"), (512, "vector", None, "c"), (512, "lexical", "bm25", "b"), (512, "lexical", "ts_rank_cd", "a"), (256, "hybrid", "bm25", "z")], "target int, strategy string, ranker string, name string")
    assert [r.name for r in suites.arm_order(arms).orderBy("place").collect()] == ["z", "a", "b", "c", "d"]
    assert admin.artifact_name(datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC), "bm25-512") == "20240102T030405Z-bm25-512.json"
    for at, name in ((datetime(2024, 1, 2), "a"), (datetime(2024, 1, 2, tzinfo=UTC), "../a")):
        with pytest.raises(ValueError):
            admin.artifact_name(at, name)
    with pytest.raises(ValueError):
        suites.found_cases(arms, "a", "name", 0, 101)


def test_frozen_vectors_are_of_this_text_and_model(spark):
    model = {"provider": "p", "model": "m", "dimensions": 2, "tokenizer": "t"}
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "chunk_id long, sha256 string")
    vectors = spark.createDataFrame([(1, "a", "p", "m", 2, "t", 1.0), (2, "old", "p", "m", 2, "t", 2.0), (3, "c", "p", "m", 3, "t", 3.0), (3, "c", "p", "m", 2, None, 3.0)], "chunk_id long, sha256 string, provider string, model string, dimensions int, tokenizer string, embedding double")
    assert rows(snapshots.freeze(chunks, vectors, 9, model), "snapshot_id", "chunk_id", "embedding") == [(9, 1, 1.0), (9, 2, None), (9, 3, None)]
    new = vectors.withColumn("embedding", F.col("embedding") * 10)
    held = snapshots.stored(vectors.where("chunk_id = 1"), new.where("tokenizer = 't'").union(new.where("dimensions = 3")), chunks)
    assert rows(held, "chunk_id", "embedding") == [(1, 1.0), (3, 30.0)]
    with pytest.raises(ValueError):
        snapshots.require_same("a", "b")


def select_by_hand(hits, k, budget):
    left, taken, dropped = max(0, budget - 2), [], []
    for chunk, cost in hits:
        if len(taken) == k:
            break
        if cost <= left:
            left -= cost
            taken.append(chunk)
        else:
            dropped.append(chunk)
    return taken, dropped


def test_evidence_is_selected_as_by_hand(spark):
    hits = [(1, 7, c, c, cost) for c, cost in enumerate([30, 30, 30, 90, 10, 10], 1)] + [(1, 8, 7, 7, 25), (1, 9, 8, 8, 40), (2, 7, 1, 1, 500)]
    got = {r.query_id: r for r in evidence.selected(spark.createDataFrame(hits, "query_id long, doc_id long, chunk_id long, rank int, cost long"), 4, 2, 130).collect()}
    natural = select_by_hand([(h[2], h[4]) for h in hits[:8]], 4, 130)
    preferred = select_by_hand([(h[2], h[4]) for h in (hits[0], hits[1], hits[6], hits[7], *hits[2:6])], 4, 130)
    assert (got[1].selected, got[1].over_budget) == preferred and got[1].over_quota == [c for c in natural[0] if c not in preferred[0]]
    assert (got[2].selected, got[2].over_quota, got[2].over_budget) == ([], [], [1])


def test_distinct_texts_and_entries(spark):
    hits = spark.createDataFrame([(1, 5, 1, "a  b"), (1, 6, 2, " a b"), (1, 7, 3, "c")], "query_id long, doc_id long, rank int, body string")
    kept, gone = evidence.distinct_texts(hits)
    assert rows(kept, "doc_id") == [(5,), (7,)] and rows(gone, "doc_id", "owner") == [(6, 5)]
    assert hits.select(evidence.entry_chars("doc_id", "body").alias("n")).first().n == len('{"body":"a  b","doc_id":5}') + 1
    assert [evidence.candidates(3), evidence.candidates(10), evidence.candidates(3, 4)] == [20, 40, 4]
    with pytest.raises(ValueError):
        evidence.candidates(5, 4)


def test_grades_of_a_question_without_any(spark):
    e = spark.createDataFrame([(1, [3, 1, 2]), (2, [4])], "query_id long, ids array<long>")
    g = spark.createDataFrame([(1, 1, True), (1, 3, True), (1, 9, True), (1, 2, None)], "query_id long, chunk_id long, relevant boolean")
    assert rows(evidence.graded(e, g), "query_id", "relevant", "unknown", "missing", "below") == [(1, [3, 1], [9], [], False), (2, [], [], [4], True)]


@pytest.mark.parametrize(
    "url,shown,kind,local",
    [
        ("https://api.openai.com/v1/embeddings", True, "openai_embeddings", False),
        ("https://api.openai.com/v1/responses", True, "openai_responses", False),
        ("http://localhost:11434/api/chat", True, "ollama", True),
        ("http://10.0.0.5/v1/models", True, "openai_compatible", True),
        ("http://172.32.0.5/x", True, "external_api", False),
        ("https://me:pw@example.org/x", False, "external_api", False),
        ("https://example.org/x?token=abc", False, "external_api", False),
        ("local://ollama", False, "ollama", True),
        ("deterministic://x", False, "deterministic", True),
        ("/etc/passwd", False, "unknown", None),
        (None, False, "unknown", None),
    ],
)
def test_addresses(spark, url, shown, kind, local):
    r = spark.createDataFrame([(url,)], "u string").select(admin.public_url(F.col("u")).alias("shown"), admin.provider(F.col("u")).alias("p")).first()
    assert (r.shown, r.p.provider, r.p.local) == (url if shown else "", kind, local)


def test_search_jobs_and_codes(spark):
    people = spark.createDataFrame([("Ann%", None), ("Bob", "x")], "a string, b string")
    assert rows(people.where(admin.holds("n%", "a", "b")), "a") == [("Ann%",)] and people.where(admin.holds(" ", "a")).count() == 2
    assert admin.none_match(people, F.col("b") == "y") and not admin.none_match(people, F.col("b") == "x")
    jobs = spark.createDataFrame([(1, 5, "running", True), (2, 5, "done", True), (3, 4, "done", None), (4, 5, "done", False)], "job_id long, created int, status string, archived boolean")
    assert [r.job_id for r in admin.newest_jobs(jobs).collect()] == [4, 1, 3] and [r.job_id for r in admin.newest_jobs(jobs, 2, True).collect()] == [4, 2]
    listing = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first")], "code string, at int, issuer string")
    assert rows(admin.issuers_of(spark.createDataFrame([("a",)], "code string"), listing), "code", "issuer") == [("a", "first")]
    with pytest.raises(Exception, match="no issuer for b"):
        admin.issuers_of(spark.createDataFrame([("b",)], "code string"), listing).collect()
    runs = spark.createDataFrame([(10, None, 4), (3, 2, None), (None, None, 1), (1, 9, 5)], "own long, server long, used_x long")
    assert rows(admin.allowance(runs, {"x": ["own", "server"]}), "left_x") == [(0,), (2,), (6,), (None,)]


def test_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    hits = empty("query_id long, doc_id long, chunk_id long, rank int, cost long")
    assert evidence.selected(hits, 3, 1, 10).count() == 0
    assert suites.bound(empty("golden_id long, k long"), empty("doc_id long, k long"), ["k"]).count() == 0
    assert rows(suites.twins(empty("case_id long, question string"), empty("case_id long, question string"), []), "problem") == [("first suite is empty",), ("second suite is empty",)]
    assert admin.source_states(empty("doc_id long"), empty("doc_id long, role string, sha256 string, archive_sha256 string")).count() == 0
