import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import identity as ident
from lodestone.functions import query as Q
from lodestone.operators import guards
from lodestone.sources import files


def test_web_search_syntax(spark):
    assert Q.websearch_tokens('net "cash flow" or -debt "open') == ["net", '"cash flow"', "or", "-debt", '"open']
    assert Q.positive_text("a or b -c -") == "a b -" and Q.exclusions('-x -"y z"') == ["x", "y z"]
    postings = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b"), (3, "d")], "doc_id int, lexeme string")
    ids = lambda q: sorted(r.doc_id for r in Q.relaxed_matches(q, postings).collect())
    assert ids("a b") == [1, 2] and ids("a b -c") == [2] and ids("-c") == [2, 3]
    texts = {1: "cash flow rose", 2: "flow of cash", 3: "cash cash flow", 4: "debt cash flow", 5: "net"}
    postings = spark.createDataFrame([(d, w, k) for d, t in texts.items() for k, w in enumerate(t.split())], "doc_id int, lexeme string, at int")
    assert ids('"cash flow"') == [1, 3, 4] and ids('net "cash flow" -debt') == [1, 3, 5] and ids('cash -"cash flow"') == [2]
    assert ids('"cash cash flow" or "of cash"') == [2, 3] and ids("cash-flow") == [1, 3, 4]


def test_aliases(spark):
    assert Q.find_aliases("amd and amd inc", ["amd", "amd inc"]) == [(0, 3, "amd"), (8, 15, "amd inc")]
    assert Q.find_aliases("sat&t rose", ["at&t"]) == [(1, 5, "at&t")] and Q.find_aliases("ab b c", ["ab b", "b c"]) == [(0, 4, "ab b")]
    assert Q.find_aliases("samd", ["amd"]) == [] and Q.find_aliases("삼성전자의", ["삼성전자"]) == [(0, 4, "삼성전자")]
    got = Q.alias_matches(spark.createDataFrame([(1, "ＡＭＤ  Inc vs Intel"), (2, None)], "query_id int, question string"), ["AMD inc", "intel"])
    assert {r.query_id: r.aliases for r in got.collect()} == {1: ["amd inc", "intel"], 2: []}
    same = spark.createDataFrame([("A b", "x"), ("a  B", "y"), ("c", "x")], "alias string, owner string")
    assert [(r.alias, r.owners) for r in Q.alias_conflicts(same).collect()] == [("a b", ["x", "y"])]
    langs = spark.createDataFrame([("abc",), ("가 b",), ("1",)], "t string").select(Q.languages(F.col("t")).alias("x")).collect()
    assert [r.x for r in langs] == [["en"], ["en", "ko"], ["en"]]


def test_identities(spark):
    assert ident.canonical_json({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    with pytest.raises(ValueError):
        ident.canonical_json(float("nan"))
    assert ident.sanitize({"api_key": 1, "x": [{"Token": 2, "n": 3}]}) == {"api_key": "[REDACTED]", "x": [{"Token": "[REDACTED]", "n": 3}]}
    token = ident.sign({"doc": 1}, b"k", 60, now=1000)
    assert ident.verify(token, b"k", now=1030) == {"doc": 1}
    for key, now in ((b"x", 1030), (b"k", 1100)):
        with pytest.raises(ValueError):
            ident.verify(token, key, now=now)
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "t string")
    assert ident.rows_digest(df, "t").first() == ident.rows_digest(df.orderBy("t").repartition(3), "t").first() != ident.rows_digest(df.distinct(), "t").first()
    assert [r.x for r in spark.createDataFrame([('{"b": 1, "a": 2}',), ("x",)], "t string").select(ident.canonical("t").alias("x")).collect()] == ['{"a":2,"b":1}', None]


def test_hashed_vectors_equal_the_reference(spark):
    data = [(1, ["net", "sales", "net"]), (2, []), (3, ["x"])]
    got = ident.hashed_vector(spark.createDataFrame(data, "id int, w array<string>"), "id", F.col("w"), 16)
    for r in got.collect():
        assert r.embedding == pytest.approx(ident.reference_vector(dict(data)[r.id], 16))
    assert got.count() == 3


def test_files(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.txt").write_bytes("한글".encode("euc-kr"))
    with zipfile.ZipFile(root / "b.zip", "w") as z:
        z.writestr("x.xml", "<a/>")
        z.writestr("y.txt", "no")
    rows = [{"artifact_id": n, "path": n, "sha256": hashlib.sha256((root / n).read_bytes()).hexdigest(), "byte_length": (root / n).stat().st_size, "role": "primary"} for n in ("a.txt", "b.zip")]
    rows.append(rows[0] | {"artifact_id": "c", "path": "gone"})
    (tmp_path / "m.json").write_text(json.dumps({"artifacts": rows}))
    got = files.verified(spark, files.manifest(spark, str(tmp_path / "m.json")), str(root))
    assert {r.path: r.ok for r in got.collect()} == {"a.txt": True, "b.zip": True, "gone": False}
    assert files.decoded(got.where("path = 'a.txt'")).first().text == "한글"
    assert [(r.name, bytes(r.content)) for r in files.members(got.where("ok")).collect()] == [("x.xml", b"<a/>")]
    (tmp_path / "n.json").write_text(json.dumps({"artifacts": [rows[0], rows[0]]}))
    with pytest.raises(ValueError, match="repeated"):
        files.manifest(spark, str(tmp_path / "n.json"))
    for bad in ('{"a": 1, "a": 2}', "[NaN]"):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    assert files.strict_json('{"a": [1]}') == {"a": [1]}
    files.snapshot(spark.range(3), str(tmp_path / "snap"), "one")
    with pytest.raises(Exception, match="(?i)exists"):
        files.snapshot(spark.range(3), str(tmp_path / "snap"), "one")
    zipped = spark.createDataFrame([([1, 2], ["a", "b"])], "n array<int>, s array<string>")
    assert [tuple(r) for r in files.flatten(zipped, ["n", "s"]).collect()] == [(1, "a"), (2, "b")]


def test_admission_equals_a_loop(spark):
    rng = random.Random(1)
    log = sorted((rng.randrange(3), rng.randrange(400)) for _ in range(150))
    limits, live, want = {10: 2, 100: 9}, {}, []
    for key, t in log:
        mine = live.setdefault(key, [])
        ok = all(sum(x > t - s for x in mine) < n for s, n in limits.items())
        if ok:
            mine.append(t)
        want.append((key, t, ok))
    got = guards.admitted(spark.createDataFrame(log, "k long, at long"), "k", "at", limits)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_batches_pins_and_verdicts(spark):
    df = spark.createDataFrame([([4, 4, 4, 9, 1, 1, 1],)], "c array<long>")
    assert df.select(guards.batches(F.col("c"), 3, 8).alias("x")).first().x == [0, 0, 1, 2, 3, 3, 3]
    hits = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "query_id int, doc_id int, rank int")
    pins = spark.createDataFrame([(1, 30, 1), (1, 40, 2)], "query_id int, doc_id int, position int")
    assert [r.doc_id for r in guards.pinned_first(hits, pins, 3).orderBy("place").collect()] == [30, 40, 10]
    answers = spark.createDataFrame([([1], [1, 2], ["verified"]), ([3], [1], []), ([1], [1], ["verified", "period_mismatch"]), ([1], [1], ["unverified"]), ([], [1], [])], "cited array<int>, relevant array<int>, figures array<string>")
    assert [r.verdict for r in guards.verdicts(answers).collect()] == ["SUPPORTED", "NOT_IN_DOCS", "PERIOD_MISMATCH", "NOT_IN_DOCS", "NOT_IN_DOCS"]


def test_rerank_matrix_unique_readiness(spark):
    hits = spark.createDataFrame([(1, 1, "q", "aa"), (1, 2, "q", "a"), (1, 3, "q", "aa")], "query_id int, doc_id int, question string, body string")
    assert [r.doc_id for r in guards.rerank(hits, lambda q, b: b.str.len(), 2).orderBy("rank").collect()] == [1, 3]
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    arms = guards.experiment_matrix(one("target", "s", "t"), one("strategy", "vector", "lexical"), one("ranker", "bm25", "cover"))
    assert sorted((r.target, r.strategy, r.ranker or "") for r in arms.collect()) == [(t, s, r) for t in "st" for s, r in (("lexical", "bm25"), ("lexical", "cover"), ("vector", ""))]
    with pytest.raises(ValueError):
        guards.unique(one("id", "a", "a"), "id")
    with pytest.raises(ValueError):
        guards.require_fresh("a", "b")
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "chunk_id int, sha256 string")
    ready = lambda v, s: guards.readiness(chunks, v, s).first().blocker
    assert [ready(chunks.limit(1), chunks), ready(chunks, chunks.limit(0)), ready(chunks, chunks)] == ["missing_vectors", "no_statistics", None]
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert tuple(guards.twin_alignment(pairs).first()) == (0.5, 0.0, 1.0)
