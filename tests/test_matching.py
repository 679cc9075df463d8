import pytest
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions.text import tokens
from lodestone.operators import admin, matching

TEXTS = {1: ("les données financières", "fr"), 2: ("Die Straße und die Märkte", "de"), 3: ("삼성 매출 증가", "ko"), 4: ("the risks of markets", "en"), 5: ("매출 감소 risk", "ko"), 6: (None, "en"), 7: ("market of risk", None)}
CASES = [
    ("données", {1}), ("Straße", {2}), ("매출", {3, 5}), ('"매출 증가"', {3}), ("매출 -증가", {5}), ("-매출", set()), ("market", {4, 7}), ("risk OR données", {1, 4, 5, 7}),
    ('"risks of market"', {4}), ('"market risks"', set()), ('"markets the risk"', {7}), ("the", set()), ("the -risk", set()), ("", set()), ("risk -markets", {5}), ("!! risk", {4, 5, 7}),
]


def test_web_searches_of_four_languages(spark):
    docs = spark.createDataFrame([(k, t, c, "x") for k, (t, c) in TEXTS.items()], "doc_id int, text string, language string, query string")
    queries = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(CASES)] + [(99, None)], "query_id int, query string")
    got = {}
    for r in matching.relaxed(queries, docs, ["doc_id"]).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {k: want for k, (_, want) in enumerate(CASES) if want}


@pytest.mark.parametrize("query,want", [("données", {1}), ("Straße", {2}), ("매출", {3, 5}), ('"매출 증가"', {3}), ("-매출", {1, 2, 4, 7}), ("매출 -감소", {3}), ("risk", {5, 7}), ("?!", set()), ("", {1, 2, 3, 4, 5, 7}), ("-Märkte", {1, 3, 4, 5, 7})])
def test_searches_of_plain_tokens(spark, query, want):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id int, text string")
    places = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("at", "lexeme"))
    assert {r.doc_id for r in Q.relaxed_matches(query, places).collect()} == want


@pytest.mark.parametrize("host,local", [("0.0.0.0", True), ("127.0.0.1", True), ("172.16.3.4", True), ("172.32.0.1", False), ("198.18.0.1", True), ("203.0.113.9", True), ("240.0.0.1", True), ("255.255.255.255", True), ("100.64.0.1", False), ("8.8.8.8", False), ("10.example.com", False), ("[::1]", True), ("[fe80::1]", True), ("[2606:4700::1]", False), ("localhost", True)])
def test_addresses_of_no_public_network(spark, host, local):
    assert spark.range(1).select(admin.provider(F.lit(f"http://{host}/v1/x")).alias("p")).first().p.local is local
