import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import docs

from lodestone.llm import packing
from lodestone.llm.packing import Limits
from lodestone.llm.queries import QUERIES, tokenizer

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def sequences(pieces):
    out = defaultdict(list)
    for p in pieces:
        out[p.sequence_id].append(p)
    return [sorted(s, key=lambda p: p.offset) for s in out.values()]


def padding(seqs, tokens):
    held = [sum(p.length for p in s) for s in seqs]
    return sum(tokens - n for n in held if n & (n - 1)), sum(held)


def keeps(seqs, limits):
    for s in seqs:
        at = 0
        for p in s:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limits.tokens and len(s) <= limits.segments and sum(p.loss for p in s) <= limits.loss


def test_encoder_equals_library(library):
    chance = random.Random(5)
    parts = ["Straße", "ΟΔΟΣ", "İstanbul", "é", "́x", " ", "\n", "\t", " ", " ", "\x1c", "don't", "I'LL", "12ab", "<|endoftext|>", "<|startoftext|>x", "日本語", "매출", "😀", "Å", "ﬁ", "--", "a_b", "ͅ", "ÀÉ", "naïve,", "'tis", "--'s", "ÿ", "×", "'D", "\r\n", ".", "\x00", "Ⅷ"]
    texts = ["", " ", "\n\n", *("".join(chance.choice(parts) for _ in range(chance.randrange(1, 30))) for _ in range(3000))]
    encode = packing.Encoder(PATH)
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(library, text), text


def test_whole_documents_in_pieces(spark, library):
    chance = random.Random(3)
    words = ["alpha", "Beta", "gamma-ray", "delta's", "Épsilon", "zz"]
    text = lambda n: " ".join(chance.choice(words) for _ in range(n))
    data = [(k, text(chance.choice([0, 1, 5, 200, 900]))) for k in range(400)] + [(1000, text(30_000)), (1001, None), (1002, ""), (None, "no id"), (7, "again"), (7, "again")]
    got = packing.pack(docs(spark, data).repartition(3), PATH).collect()
    assert got[0].asDict().keys() == {c.split()[0] for c in packing.SCHEMA.split(", ")}
    keeps(sequences(got), Limits())
    padded, held = padding(sequences(got), 2048)
    assert padded < 0.005 * held
    pieces = defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
    for k, t in data:
        if k == 7 and t != "again" or k == 7:
            continue
        want = [*ids_of(library, t), 1]
        mine = sorted(pieces[k], key=lambda p: p.start)
        assert [i for p in mine for i in np.frombuffer(p.ids, "<u4").tolist()] == want
        assert [p.start for p in mine] == [sum(q.length for q in mine[:j]) for j in range(len(mine))]
        assert {p.doc_tokens for p in mine} == {len(want)} and all(4 * p.length == len(p.ids) for p in mine)
    assert sum(p.length for p in pieces[7]) == sum(len(ids_of(library, t)) + 1 for k, t in data if k == 7)
    assert packing.pack(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("limits,fill", [(Limits(256, 4, 100), False), (Limits(256, 4, 100), True), (Limits(64, 64, 64), True), (Limits(1, 1, 1), True)])
def test_instruction_data_under_all_limits(spark, limits, fill):
    chance = random.Random(1)
    some = lambda most: " ".join("x" for _ in range(chance.randrange(most)))
    data = [(k, some(90), some(150) if k % 9 else None) for k in range(300 if limits.tokens > 1 else 10)]
    df = spark.createDataFrame(data, "doc_id long, text string, prompt string")
    got = packing.pack(df, PATH, prompt_col="prompt", limits=limits, fill=fill).collect()
    seqs = sequences(got)
    keeps(seqs, limits)
    held, bears = defaultdict(int), defaultdict(int)
    for p in got:
        held[p.doc_id] += p.length
        bears[p.doc_id] += p.loss
    size = lambda t: len((t or "").split())
    assert held == {k: size(t) + size(q) + 1 for k, t, q in data} and bears == {k: size(t) + 1 for k, t, _ in data}
    if not fill:
        assert len(got) == len(data)
        # near the least number of sequences that any limit allows
        least = max(sum(held.values()) / limits.tokens, len(data) / limits.segments, sum(bears.values()) / limits.loss)
        assert len(seqs) <= 1.35 * least + 8


def test_dot_product_mixes_prompts_with_answers():
    """Prompt-heavy and loss-heavy examples meet in one sequence, though either kind alone would break a limit or leave room."""
    packer = packing.Packer(Limits(100, 10, 50), False, 0)
    kinds = [packing.Example(k, b"", 50, 50 if k % 2 else 0) for k in range(40)]
    assert not list(packer.add(kinds))
    got = list(packer.drain(0))
    assert len(got) == 20 and all({x.prompt for x, _, _ in s} == {0, 50} for s in got)


def test_query_digests_pieces(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_packing"](spark, sf).collect()
    whole = {k: [*ids_of(library, t), 1] for k, t in texts.items()}
    for p in got:
        assert p.ids_crc32 == zlib.crc32(np.array(whole[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(whole[p.doc_id])
    assert sum(p.length for p in got) == sum(map(len, whole.values()))
    keeps(sequences(got), Limits())
    padded, held = padding(sequences(got), 2048)
    assert padded <= 0.005 * held
