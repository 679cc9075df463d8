import hashlib
import re
from collections import Counter, defaultdict

import pytest
from cases import docs, rows

from lodestone.llm import mixing, token_counts
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.queries import tokenizer

sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("bits", [None, 4])
def test_exact_dedup_equals_brute_force(spark, bits):
    data = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 200_000), (6, "A"), (7, "a "), (None, "a"), (9, "z"), (9, "z"), (None, "only")]
    groups = defaultdict(list)
    for k, t in data:
        groups[sha(t)].append(k)
    want = []
    for k, t in data:
        ids = groups[sha(t)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((k, keep, len(ids), k == keep, sha(t)))
    got = rows(exact_dedup(docs(spark, data), bits_log2=bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=repr)
    assert exact_dedup(docs(spark, []), bits_log2=bits).count() == 0


def waterfill(sizes, epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= epochs * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_mixing_targets_and_words_taken(spark):
    data = [(k, "w " * (k % 17 + 1), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)] + [(5000, None, None), (5001, "", "empty"), (5002, "a b", None), (None, "c\x0bd\x1ce", "zz"), (7, "w", "s1"), (7, "w", "s1")]
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = waterfill(sizes)
    got = mixing.mix(docs(spark, data)).collect()
    assert len(got) == len(data)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r["size"] * r.repeats if hasattr(r, "size") else True
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 9, (s, taken[s], t)
    again = mixing.mix(docs(spark, data[::-1])).collect()
    key = lambda r: (repr(r.doc_id), repr(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs(spark, [])).count() == 0


@pytest.mark.parametrize("few,slice_rows", [(50_000, 2_000), (1, 2)])
def test_repeat_takes_what_mix_says(spark, monkeypatch, few, slice_rows):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    data = docs(spark, [(k, "a b c" + " d" * (k % 5), f"s{k % 4}" if k % 9 else None) for k in range(150)] + [(500 + k, t, "s1") for k, t in enumerate([None, "", " "])] + [(None, "no id", "s2")])
    mixed = mixing.mix(data)
    out = mixing.repeat(data)
    assert out.columns == data.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({r.doc_id: r.repeats for r in mixed.collect() if r.repeats})
    assert mixing.repeat(docs(spark, [])).count() == 0


def test_documents_without_words_are_taken_with_whole_epochs_only(spark):
    data = docs(spark, [(1, "a", "a"), (2, "", "a"), (3, "b " * 50, "b"), (4, "c " * 80, "c")])
    assert {r.doc_id: r.repeats for r in mixing.mix(data).collect()}[2] <= 3
    assert sum(r.doc_id == 2 for r in mixing.repeat(data).collect()) <= 3


TEXTS = [None, "", " ", "  two  spaces ", "<s> </s> <unk>", "tab\tnew\nline　wide", "naïve ①② 한국어 🙂", "\x00\x1f", "a" * 5000, "ab c" * 4000, "🙂" * 3000, "x y" * 30_000, " " * 9000]


@pytest.mark.parametrize("chunk,overlap", [(16_384, 256), (64, 4), (7, 2)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    sp = token_counts.processor(tokenizer("piece_bpe_32k.model"))
    data = list(enumerate(TEXTS if chunk > 10 else [t for t in TEXTS if not t or len(t) < 6000])) + [(None, "no id")]
    got = rows(token_counts.token_counts(docs(spark, data), tokenizer("piece_bpe_32k.model"), chunk=chunk, overlap=overlap), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(k, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for k, t in data]
    assert got == sorted(want, key=repr)


def test_chunks_of_real_texts_splice(spark):
    sp = token_counts.processor(tokenizer("piece_bpe_32k.model"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        whole = [i for i in sp.encode(r.text)]
        assert [t[2] for t in token_counts.encode_long(sp, r.text, 200, 16)] == whole
