import pytest
from pyspark.sql import functions as F

from lodestone.functions import stemming as S

#: Published pairs of words and stems.
PAIRS = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist|consists consist|consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol|consonant conson|consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir|constable constabl|constables constabl|constance constanc|constancy constanc|constant constant
knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee|kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife|knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive|knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot
volatility volatil|impairment impair|goodwill goodwil|charges charg|fiscal fiscal|revenues revenu|recognition recognit|rates rate|interest interest|generate generat|generates generat|generalization general|communication communic|arsenal arsenal|flies fli|ties tie|dies die|gas gas|this this|gaps gap|kiwis kiwi|agreed agre|hopping hop|hoping hope|luxuriated luxuri|hop hop|cry cri|by by|say say|skis ski|dying die|news news|succeed succeed|relational relat|analogi analog|rationally ration|happiness happi|formative format|adoption adopt|controll control|sky sky|yes yes|youth youth|boyish boyish|bed bed|shed shed|bead bead|beds bed|disturb disturb|cease ceas|falling fall|fizzed fizz|feed feed|bled bled""".replace("\n", "|").split("|")


def test_published_stems():
    assert {w: S.stem(w) for w, _ in map(str.split, PAIRS)} == dict(map(str.split, PAIRS))


def test_lexemes_by_plan(spark):
    rows = [(1, "The risks of Markets, and market-risk don't matter", "en"), (2, "매출 증가율 the AMD", "ko"), (3, None, "en"), (4, "", None), (5, "of the", "fr"), (6, "Élans étés", "fr")]
    got = {r.id: r.x for r in spark.createDataFrame(rows, "id int, text string, language string").select("id", S.lexemes(F.col("text"), F.col("language")).alias("x")).collect()}
    assert got == {1: ["risk", "market", "market", "risk", "matter"], 2: ["매출", "증가", "가율", "the", "amd"], 3: [], 4: [], 5: [], 6: ["élan", "étés"]}


@pytest.mark.parametrize("texts", [[], [None], ["one"], ["running runs ran"] * 3])
def test_batches_of_any_size(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(S.lexemes(F.col("text"), F.lit("en")).alias("x"))
    want = {None: [], "one": ["one"], "running runs ran": ["run", "run", "ran"]}
    assert [r.x for r in df.collect()] == [want[t] for t in texts]


@pytest.mark.parametrize("variant,b,want", [("lucene", 0.75, [0.7793, 0.6260, 0.1556, 0.7040, 0.1040]), ("lucene", 0.0, [0.6586, 0.6260, 0.1595, 0.8281, 0.0870]), ("robertson", 0.75, [-4.1174, -2.7344, -4.2889, -2.3212, -2.8670])])
def test_bm25_of_a_written_index(spark, variant, b, want):
    from lodestone.operators import indexing, ranking

    texts = ["Risks of the market: risk", "risk, markets, volatility and interest rates", "risk " * 6, "Risk. Market market goodwill impairments charged fiscal years", "a risk in revenue recognition"]
    rows = [(k + 1, t, "en") for k, t in enumerate(texts)] + [(9, "of the", "en"), (10, None, "en"), (11, "매출 market", "ko")]
    index = indexing.forward(spark.createDataFrame(rows, "id int, body string, language string"), ["id"])
    questions = spark.createDataFrame([(1, "the market risk market"), (2, "매출액")], "query_id int, question string")
    got = {(r.query_id, r.id): r.score for r in ranking.bm25_index(questions, index, ["id"], b=b, variant=variant).collect()}
    assert [round(got[1, k], 4) for k in range(1, 6)] == pytest.approx(want, abs=1e-4)
    best = {(r.query_id, r.id): r.score for r in ranking.bm25_best(questions, index, ["id"], 50, b=b, variant=variant).collect()}
    assert best == pytest.approx({k: round(v, 6) for k, v in got.items()}, abs=2e-6)
    two = [(r.query_id, r.id, r["rank"]) for r in ranking.bm25_best(questions, index, ["id"], 2, b=b, variant=variant).orderBy("query_id", "rank").collect()]
    order = sorted((k for k in best if k[0] == 1), key=lambda k: (-best[k], k[1]))[:2]
    assert two == [(1, order[0][1], 1), (1, order[1][1], 2), (2, 11, 1)]
    assert ranking.bm25_best(questions.limit(0), index, ["id"], 2).count() == 0
    # a Korean chunk is asked by Korean pairs, whole Latin words included
    assert set(got) == {(1, k) for k in range(1, 6)} | {(1, 11), (2, 11)}


def test_an_index_that_is_not_ready_raises_without_hits_too(spark):
    from lodestone.operators import indexing, ranking

    chunks = spark.createDataFrame([(1, "risk", "en", "a"), (2, "market", "en", "b"), (3, None, "en", None)], "id int, body string, language string, version string")
    index = indexing.forward(chunks, ["id", "version"])
    asked = spark.createDataFrame([(1, "risks"), (2, "of the"), (2, "of the")], "query_id int, question string")

    def told(chunks, **k):
        hits = ranking.bm25_index(asked, index, ["id"])
        return {(r.query_id, r.id, r.ready, r.n_missing, r.n_stale, r.n_orphans) for r in ranking.answered(asked, hits, indexing.readiness(chunks, index, ["id"], "version"), **k).collect()}

    assert told(chunks) == {(1, 1, True, 0, 0, 0), (2, None, True, 0, 0, 0)}
    other = chunks.where("id <> 3").withColumn("version", F.when(F.col("id") == 1, "x").otherwise(F.col("version"))).union(spark.sql("SELECT 9, 'new', 'en', 'c'"))
    assert told(other, strict=False) == {(1, 1, False, 1, 1, 1), (2, None, False, 1, 1, 1)}
    with pytest.raises(Exception, match="n_missing 1 n_stale 1 n_orphans 1"):
        told(other)
    with pytest.raises(Exception, match="not ready: n_chunks 0"):
        told(chunks.limit(0))
