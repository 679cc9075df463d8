import random
import re

import pytest

from lodestone.operators import units as U
from lodestone.operators.chunking import Budget

SCHEMA = "doc_id long, block_no int, kind string, text string, source_group int, source_heading string, captions array<string>, citation string, title string, start_char long, end_char long, run int"


def words(text):
    return len(re.findall(r"\w+", text))


def brute(blocks, budget):
    """One pass with the state in hand."""
    out, pending, captions, headings, run, group = [], [], [], [], False, "none"

    def flush():
        if pending:
            out.append(("text", "\n\n".join(b[3] for b in pending), " · ".join(headings) or None, [], pending[0][9], pending[-1][10]))
            pending.clear()

    for b in blocks:
        kind, text = b[2], b[3] or ""
        if b[4] != group:
            flush()
            group, headings, run, captions = b[4], [b[5]] if b[5] else [], False, []
        if kind == "heading":
            flush()
            headings = [*headings, text] if run else [text]
            run, captions = True, []
        elif kind == "table":
            flush()
            own = [(c, b[9], b[10]) for c in b[6] or []]
            if text.strip():
                heading = " · ".join([*headings, *dict.fromkeys(c for c, _, _ in captions)]) or None
                out.append(("table", text, heading, captions + own, b[9], b[10]))
                captions, run = [], False
            else:
                captions = captions + own
        elif text.strip():
            if re.match(r"^\(\s*단위\s*[:：]?\s*[^)]*\)$", text.strip()):
                captions = [*captions, (text.strip(), b[9], b[10])]
                continue
            run, captions = False, []
            head = " · ".join(x for x in (b[7], b[8], " · ".join(headings)) if x)
            joined = "\n\n".join([*(p[3] for p in pending), text])
            if pending and (words(head) + words(joined) > budget.target or len(head) + 2 + len(joined) > budget.chars):
                flush()
            pending.append(b)
    flush()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_units_equal_a_pass_with_state(spark, seed):
    chance = random.Random(seed)
    budget = Budget(12, 100, 120)
    rows, want = [], {}
    for doc in range(60):
        at, mine, group = 0, [], 0
        for n in range(chance.randrange(0, 30)):
            group += chance.random() < 0.1
            kind = chance.choice(["text"] * 4 + ["heading", "table"])
            text = {"text": chance.choice(["", " ", None, "(단위 : 원)", " (단위 백만원) ", "a b c", "long " * 9, "x" * 130, "one two three four five"]), "heading": f"H{chance.randrange(3)}", "table": chance.choice(["", "| a |", "| b |\n| c |"])}[kind]
            captions = chance.choice([None, [], ["(단위 : 원)"], ["(단위 : 천원)", "(기준일 : x)"]]) if kind == "table" else None
            size = len(text or "") + 1
            # groups come back, and one is null: only a change counts
            mine.append((doc, n, kind, text, [1, None, 2, 1][group % 4], [None, "G", ""][group % 3], captions, "Acme FY2024", "T", at, at + size, 5))
            at += size
        rows += mine
        want[doc] = brute(mine, budget)
    chance.shuffle(rows)
    got = {}
    for r in U.units(spark.createDataFrame(rows, SCHEMA), ["doc_id"], budget).orderBy("doc_id", "unit_no").collect():
        assert r.unit_no == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.kind, r.body, r.heading, [tuple(c) for c in r.captions], r.start_char, r.end_char))
    assert got == {k: v for k, v in want.items() if v}
    kinds = {k for v in want.values() for k, *_ in v}
    assert kinds == {"text", "table"} and any(c for v in want.values() for _, _, _, c, _, _ in v)


def test_no_blocks(spark):
    assert U.units(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
