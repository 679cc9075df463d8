import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from cases import docs

from lodestone.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def brute(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    told = [(k, *features(text)) for k, text in rows]
    for side, many in ((s, [f for _, _, f in told]), (t, [features(x)[1] for x in target])):
        for f in many:
            for g, n in f.items():
                side[bucket(g)] += n
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in {*s, *t}}
    out = []
    for k, n_words, f in told:
        n = sum(f.values())
        weight = sum(gain[bucket(g)] * c for g, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n_words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for place, r in enumerate(able[: 25 * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("block", [8 << 20, 2_000])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    chance = random.Random(2)
    vocabulary = ["The", "the", "risk", "Übung", "日本", "x1", "a-b", "don't", "e\x7ff", "İ", *(f"w{k}" for k in range(60))]
    text = lambda n: chance.choice([" ", "\n", "--", " \t"]).join(chance.choice(vocabulary) for _ in range(n))
    rows = [(k, text(chance.choice([1, 3, 19, 20, 45, 200]))) for k in range(300)] + [(400, None), (401, ""), (402, " .. "), (403, text(20_000)), (None, text(30)), (7, "same " * 25), (7, "same " * 25)]
    target = [text(30).replace("risk", "w1 w2") for _ in range(20)] + [None, ""]
    got = resampling.resample(docs(spark, rows).repartition(3), docs(spark, [(k, t) for k, t in enumerate(target)]))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(rows, target)


def test_empty_tables(spark):
    none, some = docs(spark, []), docs(spark, [(k, "a b " * 20) for k in range(8)])
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(some, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and {r.n_features for r in got} == {79}
    assert resampling.resample(none, none).count() == 0


def test_draws_what_is_like_the_target(spark):
    rows = [(k, ("alpha beta gamma delta " if k % 4 == 0 else f"noise{k % 7} other{k % 11} plain words ") * 100) for k in range(400)]
    got = resampling.resample(docs(spark, rows), docs(spark, [(1, "alpha beta gamma delta " * 5000)])).collect()
    drawn = [r.doc_id for r in got if r["rank"] is not None]
    assert len(drawn) == 100 and sum(k % 4 == 0 for k in drawn) > 70
