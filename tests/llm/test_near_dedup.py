import random
import re

import numpy as np
import pytest
from cases import docs, rows

from lodestone.llm import near_dedup
from lodestone.llm.components import components


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def union(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute_force(data):
    sets = {k: shingle_set(t) for k, t in data}
    ids = sorted(k for k, _ in data if k is not None)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return [(k, len(sets[k]), c, k == c) for k, c in union(edges, ids).items()]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    data, k = [], 0
    for group in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40 + (len(base) > 10))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) * 9 // 10)]
            data.append((k * 7 % 1009, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
            k += 1
    return data


def test_equals_brute_force(spark):
    data = texts() + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "É a b c d"), (2004, "é a b c d"), (2005, "x " * 30_000), (2006, "X\x0b" * 30_001)]
    got = rows(near_dedup.near_duplicates(docs(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_force(data), key=repr)


@pytest.mark.parametrize("few,crowd,block", [(8, 16, 500_000), (1, 16, 200), (10_000, 2, 900)])
def test_a_large_group_of_near_copies(spark, monkeypatch, few, crowd, block):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    data = []
    for k in range(160):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        data.append((k * 11 % 499, " ".join(copy)))
    got = rows(near_dedup.near_duplicates(docs(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
    want = sorted(brute_force(data), key=repr)
    assert 1 < sum(r[3] for r in want) < 150
    assert got == want


def test_rows_without_ids_and_empty_tables(spark):
    got = rows(near_dedup.near_duplicates(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (0, "a b")])), "doc_id", "component_id", "kept")
    assert got == sorted([(None, None, True), (1, 0, False), (1, 0, False), (0, 0, True)], key=repr)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_documents_equal_brute_force(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = rows(near_dedup.near_duplicates(docs(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_force(data), key=repr)


@pytest.mark.parametrize("overlap", [100, 500, 900])
def test_superminhash_estimates_similarity(overlap):
    a = near_dedup.mixed(np.arange(1, 2001, dtype=np.uint64))
    sets = [a[:1000], a[1000 - overlap : 2000 - overlap]]
    got = near_dedup.superminhash(np.repeat([0, 1], 1000), np.concatenate(sets), 2, 2048)
    assert abs((got[0] == got[1]).mean() - overlap / (2000 - overlap)) < 0.04
    registers = near_dedup.superminhash(np.zeros(3, np.int64), a[:3], 2, 64)
    assert np.isfinite(registers[0]).all() and np.isinf(registers[1]).all()
    # one element alone fills every register once: its offers are a permutation
    assert sorted(np.floor(near_dedup.superminhash(np.zeros(1, np.int64), a[:1], 1, 64)[0])) == list(range(64))


@pytest.mark.parametrize("block", [500_000, 50])
def test_components_of_random_graphs(spark, monkeypatch, block):
    monkeypatch.setattr("lodestone.llm.components.BLOCK", block)
    rng = random.Random(5)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)] + [(4000 + k, 4001 + k) for k in range(60)] + [(9000, 9000 + k) for k in range(1, 400)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = union([e for e in edges if None not in e], {n for e in edges if None not in e and e[0] != e[1] for n in e} | {7})
    got = dict(rows(components(df), "node", "component"))
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for n, c in want.items() if n != c} <= got.keys()
    assert components(df.limit(0)).count() == 0


def stragglers():
    """A large group of near copies, some of which are linked with few others or none."""
    rng = random.Random(4)
    base, data = [f"b{k}" for k in range(120)], []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(0, 16)):
            copy[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        data.append((k * 11 % 997, " ".join(copy)))
    return data


def test_places_are_not_listed_again_and_again(spark, monkeypatch):
    rows_of, table = [], near_dedup.table

    def counted(df, *args, **more):
        out = table(df, *args, **more)
        rows_of.extend([out.count()] if {"band", "doc"} <= set(out.columns) else [])
        return out

    monkeypatch.setattr(near_dedup, "table", counted)
    data = stragglers()
    got = rows(near_dedup.near_duplicates(docs(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_force(data), key=repr)
    assert sum(rows_of) < 5 * max(rows_of)


@pytest.mark.parametrize("head", [64, 3])
def test_hubs_are_tried_by_documents_that_may_be_linked(spark, monkeypatch, head):
    pairs_of, verified = [], near_dedup._verified

    def counted(pairs, sets, percent):
        pairs_of.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    monkeypatch.setattr(near_dedup, "HEAD", head, raising=False)
    data = stragglers()
    got = rows(near_dedup.near_duplicates(docs(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_force(data), key=repr)
    *tries, _ = pairs_of
    assert 0 < sum(tries) < len(data)
