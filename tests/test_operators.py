import itertools
import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog, evaluation, parsing, ranking, usage

BM25 = {"d1": "risk market risk", "d2": "risk market volatil interest rate", "d3": "risk risk risk risk risk risk", "d4": "risk market market goodwil impair charg fiscal year", "d5": "risk revenu recogn"}


@pytest.mark.parametrize(
    "variant,b,want",
    [("lucene", 0.75, [0.7793, 0.6260, 0.1556, 0.7040, 0.1040]), ("lucene", 0.0, [0.6586, 0.6260, 0.1595, 0.8281, 0.0870]), ("robertson", 0.75, [-4.1174, -2.7344, -4.2889, -2.3212, -2.8670]), ("robertson", 0.0, [-3.6336, -2.7344, -4.3961, -2.8605, -2.3979])],
)
def test_bm25(spark, variant, b, want):
    postings = spark.createDataFrame([(k, "en", w) for k, t in BM25.items() for w in t.split()], "doc_id string, language string, lexeme string").groupBy("doc_id", "language", "lexeme").agg(F.count(F.lit(1)).alias("tf"))
    for q in ("market risk", "market risk market"):
        got = ranking.bm25(spark.createDataFrame([(1, q)], "query_id int, question string"), postings, b=b, variant=variant)
        assert [round(r.score, 4) for r in got.orderBy("doc_id").collect()] == want


def test_bm25_parameters():
    for bad in ((0, 0.5, "lucene"), (1, 1.5, "lucene"), (1, 0.5, "x")):
        with pytest.raises(ValueError):
            ranking.check_bm25(*bad)


def test_fusion(spark):
    lanes = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 2, 2), (1, "b", 2, 1), (1, "b", 3, 2), (1, "c", 2, 1), (2, "a", 7, 1), (2, "a", 7, 2), (2, "b", 7, 1)], "query_id int, lane string, doc_id int, rank int")
    got = {(r.query_id, r.doc_id): r for r in ranking.fuse(lanes, 5).collect()}
    assert [got[1, k].rank for k in (2, 1, 3)] == [1, 2, 3] and got[1, 2].score == pytest.approx(1 / 62 + 1 / 61 + 1 / 61)
    assert ranking.fuse(lanes, 5, rrf_k=10).where("query_id = 2").first().score == pytest.approx(2 / 11)


def test_cover_density_equals_brute_force(spark):
    docs = {1: "a b x a b", 2: "a x x b", 3: "a a", 4: "b y a y b z a"}
    rows = [(k, w, n) for k, t in docs.items() for n, w in enumerate(t.split(), 1)]
    got = {r.doc_id: r.score for r in ranking.cover_density(spark.createDataFrame([(1, "a b")], "query_id int, question string"), spark.createDataFrame(rows, "doc_id int, lexeme string, place int")).collect()}
    want = {}
    for k, t in docs.items():
        w = t.split()
        held = [(s, e) for s, e in itertools.combinations_with_replacement(range(1, len(w) + 1), 2) if {"a", "b"} <= set(w[s - 1 : e])]
        covers = sorted(c for c in held if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in held))
        if covers:
            mids = [(s + e) / 2 for s, e in covers]
            gaps = [max(1.0, b - a) for a, b in itertools.pairwise(mids)]
            want[k] = sum(1 / (e - s) for s, e in covers) / (sum(gaps) / len(gaps) if gaps else 1) / (1 + math.log(len(w)))
    assert got == pytest.approx(want)


def test_fill_passes_over_what_is_too_large(spark):
    hits = spark.createDataFrame([(1, k, 10 * k, c) for k, c in enumerate([5, 9, 4, 1, 1], 1)], "query_id int, rank int, doc_id long, cost long")
    assert ranking.fill(hits, 3, 10).first().taken == [10, 30, 40]


@pytest.mark.parametrize("hit,relevant", [((150, 300), True), ((151, 300), False), ((0, 1000), True)])
def test_relevance(spark, hit, relevant):
    gold = spark.createDataFrame([(1, 5, 1, 100, 200)], "query_id int, doc_id int, gold_no int, start_char long, end_char long")
    hits = spark.createDataFrame([(1, 5, 1, *hit)], "query_id int, doc_id int, rank int, start_char long, end_char long")
    assert evaluation.relevance(hits, gold).first().relevant == relevant
    score = evaluation.case_scores(spark.createDataFrame([(1,)], "query_id int"), hits, gold, 5).first()
    assert (score.recall, score.hit) == (float(relevant), int(relevant))


def test_gates(spark):
    runs = lambda v: spark.createDataFrame(v, "metric string, value double")
    got = {r.metric: r.regressed for r in evaluation.regressions(evaluation.compare_metrics(runs([("a", 0.5), ("b", 0.5), ("c", 0.1)]), runs([("a", 0.45), ("b", 0.44), ("d", 1.0)])), 0.05).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}
    arms = spark.createDataFrame([("x", "en", 0.8), ("x", "ko", 0.68), ("y", "en", 0.0), ("y", "ko", 0.1), ("z", "en", 0.5), ("z", "ko", 0.4)], "arm string, language string, recall double")
    assert {r.arm: r.passes for r in evaluation.parity(arms, ["arm"], "en", "ko").collect()} == {"x": True, "y": None, "z": False}


@pytest.mark.parametrize(
    "rows,want",
    [
        ([[("A", 1, 1), ("B", 1, 1)], [("C", 1, 1)]], [["A", "B"], ["C", ""]]),
        ([[("A", 2, 1), ("b1", 1, 1)], [("b2", 1, 1)]], [["A", "b1"], ["", "b2"]]),
        ([[("wide", 1, 3), ("x", 1, 1)]], [["wide", "", "", "x"]]),
        ([], []),
    ],
)
def test_tables(rows, want):
    assert parsing.place_cells(rows) == want
    assert parsing.markdown([["a|b", "c"], ["1", "2"]]) == "| a\\|b | c |\n| --- | --- |\n| 1 | 2 |"


def test_html_blocks(spark):
    html = "<html><head><title>no</title></head><body>\n<h1>A &amp; B</h1><p>one <b>two</b></p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>tail</body></html>"
    got = parsing.block_spans(parsing.leaf_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))).orderBy("block_no").collect()
    assert [(r.tag, r.text) for r in got] == [("h1", "A & B"), ("p", "one two"), ("td", "1"), ("td", "2"), ("body", "tail")]
    assert all(html[r.start :].startswith(r.text.split()[0]) for r in got) and [r.end for r in got][:-1] == [r.start for r in got][1:]


def test_ranges_and_packing(spark):
    pages = spark.createDataFrame([(5,), (70,), (500,)], "page long")
    ranges = spark.createDataFrame([("wide", 0, 200), ("near", 60, 130), ("tie", 60, 130)], "name string, low long, high long")
    assert {r.page: r["name"] for r in parsing.narrowest(pages, ranges).collect()} == {5: "wide", 70: "near"}
    df = spark.createDataFrame([(["aa", "bb", "cccccc", "d"],)], "s array<string>")
    assert df.select(parsing.pack(F.col("s"), 6).alias("x")).first().x == ["aa bb", "cccccc", "d"]


def test_catalog(spark):
    assert catalog.Filters(languages=("b", "a", "b")) == catalog.Filters(languages=("a", "b"))
    assert not catalog.Filters(languages=("a",)).needs_documents and catalog.Filters(forms=("x",)).needs_documents
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (3, None)], "k int, v string")
    assert {r.k: r.v for r in catalog.unanimous(rows, "k", "v").collect()} == {1: "a", 2: None, 3: None}
    with pytest.raises(Exception, match="rows in a group: 2"):
        catalog.exactly_one(rows, ["k"], "v").collect()
    assert catalog.schema_drift(rows, ["k", "w"]) == ["w"]
    first, cursor = catalog.page(spark.range(10), [F.col("id").asc()], 4)
    assert [r.id for r in first.collect()] == [0, 1, 2, 3] and [r.id for r in catalog.page(spark.range(10), [F.col("id").asc()], 4, cursor)[0].collect()] == [4, 5, 6, 7]


def test_costs(spark):
    df = spark.createDataFrame([(1000, 200, 50)], "r long, c long, o long")
    assert float(df.select(usage.token_cost(F.col("r"), F.col("c"), F.col("o"), ("2.5", "1.25", "10")).alias("x")).first().x) == pytest.approx(0.00325)


@pytest.mark.parametrize("text,want", [("53-67", [(53, 67)]), ("70", [(70, 70)]), ("88 -86", [(86, 88)]), ("1 05", [(105, 105)]), ("8 6", [(86, 86)]), ("19 44", [(19, 19), (44, 44)]), ("12, 30–31 and 2024", [(12, 12), (30, 31)]), ("", [])])
def test_page_ranges(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parsing.page_ranges(F.col("t")).alias("x")).first().x
    assert [(r.low, r.high) for r in got] == want


@pytest.mark.parametrize(
    "blocks,want",
    [
        ({0: "1", 6: "2", 12: " 3\n"}, [(0, 1), (6, 2), (12, 3)]),  # a chain from the start
        ({0: "1", 3: "2", 9: "5"}, [(0, 1)]),  # too near, then a step too far
        ({0: "1", 6: "50", 12: "2"}, [(0, 1), (12, 2)]),  # a figure between footers
        ({0: "71", 5: "72", 10: "74", 15: "75"}, [(0, 71), (5, 72), (10, 74), (15, 75)]),  # three in a row begin a chain
        ({0: "71", 5: "72"}, []),
        ({0: "1", 6: "30", 12: "31", 18: "1", 24: "32", 30: "33", 36: "34"}, [(0, 1), (24, 32), (30, 33), (36, 34)]),  # a smaller number ends a run
        ({0: "1", 6: "30", 12: "31", 18: "2", 24: "32"}, [(0, 1), (18, 2)]),  # a number that follows comes before a run's end
        ({0: "9999", 6: "x", 12: None}, []),
        ({}, []),
    ],
)
def test_page_marks(spark, blocks, want):
    df = spark.createDataFrame([(1, k, t) for k, t in blocks.items()] + [(2, 0, "7")], "doc_id int, block_no int, text string")
    assert sorted((r.block_no, r.page) for r in parsing.page_marks(df).where("doc_id = 1").collect()) == want


def test_follow_ups(spark):
    from lodestone.operators.conversations import follow_ups

    said = {
        1: ["Amdahl and AMD revenue 2023", "and AMD margins in 2024", "and in 2022년?", "so Intel", "hello", "so what"],
        2: ["so first", None, "Tell me AT&T costs", "so 2019", "and sat&t"],
        3: ["Tell me Intel", "Tell me more of Intel in 2020", "and cash"],
    }
    turns = [(c, 2 * k, "user", t) for c, texts in said.items() for k, t in enumerate(texts)] + [(1, 1, "assistant", "Tell me Intel 2001")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r["query"] for r in follow_ups(df, ["amd", "Intel", "at&t"], lambda t: t.rlike("revenue|Tell"), lambda t: t.rlike("^(and|so) ")).collect()}
    assert [got[1, 2 * k] for k in range(6)] == [
        "Amdahl and AMD revenue 2023",
        "Amdahl and   revenue — and AMD margins in 2024",
        "Amdahl and   revenue — and AMD margins in — and in 2022년?",
        "Amdahl and   revenue — and   margins in — and in 2022년? — so Intel",
        "hello",
        "so what",
    ]
    assert [got[2, 2 * k] for k in range(5)] == ["so first", "", "Tell me AT&T costs", "Tell me AT&T costs — so 2019", "Tell me   costs — so 2019 — and sat&t"]
    assert [got[3, 2 * k] for k in range(3)] == ["Tell me Intel", "Tell me more of Intel in 2020", "Tell me more of Intel in 2020 — and cash"]
    assert follow_ups(df.limit(0), [], lambda t: t == "", lambda t: t == "").count() == 0


def test_verdicts_of_mixed_periods_and_labels(spark):
    from lodestone.operators.figures import check_figures

    answers = spark.createDataFrame([(1, "It was 14 and 20 and 31 and 7.", [2024])], "answer_id int, answer string, requested array<int>")
    rows = [(1, "14", [2023], False), (1, "14", [], False), (1, "20", [2023], False), (1, "31", None, True), (1, "7", [2024], None)]
    evidence = spark.createDataFrame(rows, "answer_id int, value string, years array<int>, label boolean")
    got = {r.figure: (r.verdict, r.found_years) for r in check_figures(answers, evidence).collect()}
    assert got == {"14": ("unverified", [2023]), "20": ("period_mismatch", [2023]), "31": ("verified", []), "7": ("verified", [2024])}


def test_conflicts_headers_and_stable_misses(spark):
    lanes = spark.createDataFrame([(1, "a", 7, 1, "x"), (1, "b", 7, 2, "y")], "query_id int, lane string, doc_id int, rank int, identity string")
    with pytest.raises(Exception, match="two identities"):
        ranking.fuse(lanes, 5).collect()
    assert ranking.fuse(lanes.where("lane = 'a'"), 5).count() == 1
    hits = spark.createDataFrame([(1, 5, 1, "h1", "b"), (1, 6, 2, "h2", "b"), (1, 7, 3, "h1", " b ")], "query_id int, doc_id int, rank int, header string, body string")
    assert {r.doc_id: r.owner for r in ranking.text_owner(hits).collect()} == {5: 5, 6: 6, 7: 5}
    before, after = (spark.createDataFrame(x, "query_id int, doc_id int, rank int") for x in ([(1, 1, 1), (1, 2, 2)], [(1, 1, 3), (1, 3, 1)]))
    asked = spark.createDataFrame([(1, 9), (1, 1)], "query_id int, doc_id int")
    assert {r.doc_id: r.change for r in ranking.transitions(before, after, asked).collect()} == {1: "stable_hit", 2: "hit_to_miss", 3: "miss_to_hit", 9: "stable_miss"}
    with pytest.raises(Exception, match="longer than 5"):
        spark.createDataFrame([(["aa", "cccccc"],)], "s array<string>").select(parsing.pack(F.col("s"), 5)).collect()
