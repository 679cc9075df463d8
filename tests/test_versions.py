import hashlib
from collections import Counter

import pytest

from lodestone.operators import versions as V

SCHEMA = "case_id string, question string, n long"


def brute(texts, fan):
    entries = sorted((hashlib.sha256(t.encode()).hexdigest(), n) for t, n in Counter(texts).items())
    digits = next(k for k in range(9) if len(entries) <= fan * 16**k)
    level = [(d[:digits], f"{d}:{n}") for d, n in entries]
    for k in range(digits, -1, -1):
        groups = {}
        for p, e in level:
            groups.setdefault(p[:k], []).append(e)
        level = [(p, hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()) for p, x in groups.items()]
    return level[0][1]


@pytest.mark.parametrize("fan", [4096, 3, 1])
def test_hash_of_rows_in_any_order(spark, fan):
    rows = [(f"c{k}", None if k % 7 == 0 else "é", k % 3) for k in range(40)] + [("c1", "é", 1)] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    text = lambda c, q, n: f'{{"case_id":"{c}","n":{n},"question":' + ("null}" if q is None else f'"{q}"}}')
    assert V.content_hash(df, fan) == V.content_hash(df.repartition(5).orderBy("n").select("n", "question", "case_id"), fan) == brute([text(*r) for r in rows], fan)
    assert V.content_hash(df.distinct(), fan) != V.content_hash(df, fan) and V.content_hash(df.limit(0), fan) == hashlib.sha256().hexdigest()


def test_writers_who_have_not_seen_the_head_lose(spark, tmp_path):
    root, rows = str(tmp_path), lambda *q: spark.createDataFrame([("a", x, 1) for x in q], SCHEMA)
    assert V.head(spark, root, "golden") is None
    with pytest.raises(ValueError, match="no version"):
        V.read(spark, root, "golden")
    first = V.commit(rows("one"), root, "golden", None)
    assert V.head(spark, root, "golden") == first == V.content_hash(rows("one"))
    with pytest.raises(V.Conflict, match="not at None"):
        V.commit(rows("late"), root, "golden", None)
    second = V.commit(rows("one", "two"), root, "golden", first)
    with pytest.raises(V.Conflict):
        V.commit(rows("three"), root, "golden", first)
    assert V.commit(rows("two", "one"), root, "golden", second) == second  # the same rows move nothing
    assert {r.question for r in V.read(spark, root, "golden").collect()} == {"one", "two"}
    assert [r.question for r in V.read(spark, root, "golden", first).collect()] == ["one"]
    # back to rows that were there before: a new move to an old version
    assert V.commit(rows("one"), root, "golden", second) == first == V.head(spark, root, "golden")


def test_a_race_has_one_winner(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path), lambda q: spark.createDataFrame([("a", q, 1)], SCHEMA)
    first = V.commit(rows("one"), root, "golden", None)
    seen = V._heads(spark, root, "golden")
    other = V.commit(rows("other"), root, "golden", first)
    # this writer read the heads before the other one wrote
    monkeypatch.setattr(V, "_heads", lambda *_: seen)
    with pytest.raises(V.Conflict, match="another writer"):
        V.commit(rows("mine"), root, "golden", first)
    monkeypatch.undo()
    assert V.head(spark, root, "golden") == other
    # a writer died before it told its version
    (tmp_path / "golden/heads/3").write_text("")
    assert V.head(spark, root, "golden") == other
    assert V.commit(rows("next"), root, "golden", other) == V.head(spark, root, "golden")
