import random

import pytest
from cases import docs, rows
from pyspark.sql import functions as F

from lodestone.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(data, edits=2, least=32):
    """data with unique ids."""
    places = sorted((k is None, k or 0, n, line) for k, t in data for n, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\x0b\f\r"))
    first = {}
    for p in places:
        first.setdefault(p[3], p[:3])
    long = [x for x in first if len(x) >= least]
    near = {a if first[a] > first[b] else b for i, a in enumerate(long) for b in long[i + 1 :] if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    gone = {p[:3] for p in places if p[3] in near or first[p[3]] != p[:3]}
    out = []
    for k, t in data:
        parts = (t or "").split("\n")
        stay = [x for n, x in enumerate(parts) if (k is None, k or 0, n) not in gone]
        out.append((k, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out, key=repr)


def edited(rng, line, n):
    for _ in range(n):
        k = rng.randrange(len(line) + 1)
        line = rng.choice([line[:k] + "ß" + line[k:], line[:k] + line[k + 1 :], line[:k] + "🙂" + line[k + 1 :]])
    return line


def texts():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([3, 31, 32, 33, 34, 60, 120]))) for _ in range(60)]
    return [(k * 13 % 997, "\n".join(edited(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(1, 9)))) for k in range(120)]


@pytest.mark.parametrize("edits,hot", [(1, 16), (2, 16), (3, 16), (2, 1)])
def test_equals_brute_force(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(ld, "HOT", hot)
    data = texts() + [(2000, None), (2001, ""), (2002, "\n \n\n"), (2003, "same\nsame\n\nsame"), (2004, "same\r"), (None, "same\nother"), (2005, "long " * 40_000), (2006, "long " * 40_000 + "x")]
    got = rows(ld.line_dedup(docs(spark, data), edits=edits), "doc_id", "text", "n_lines", "n_gone")
    small = [d for d in data if d[0] not in (2005, 2006)]
    assert [g for g in got if g[0] not in (2005, 2006)] == brute_force(small, edits)
    assert [g[1:] for g in got if g[0] in (2005, 2006)] == [("long " * 40_000, 1, 0), ("", 1, 1)]


def test_repeated_rows_and_empty_tables(spark):
    got = rows(ld.line_dedup(docs(spark, [(1, "a\nb"), (1, "a\nb"), (2, "b\nc"), (2, "b\nd")])), "doc_id", "text")
    assert got[:2] == [(1, "a\nb"), (1, "a\nb")] and sorted(g[1] for g in got[2:]) == ["c", "d"]
    assert ld.line_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_automaton_equals_dynamic_programming(spark, edits):
    rng = random.Random(edits)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld.within(F.col("a"), F.col("b"), edits).alias("ok")).collect()
    assert all(r.ok == (distance(r.a, r.b) <= edits) for r in got)
    kept = spark.createDataFrame(pairs, "a string, b string").where(ld.similar(F.col("a"), F.col("b"), edits))
    assert rows(kept, "a", "b") == sorted([p for p in pairs if distance(*p) <= edits], key=repr)
