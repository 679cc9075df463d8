import random
import re

import pytest

from lodestone.operators import tables as X
from lodestone.operators.chunking import Budget

CELLS = f"doc_id long, row_no int, col int, header boolean, text string, sources {X.SPANS}, piece_of string"
NOTES = f"doc_id long, context string, captions {X.CAPTIONS}"


def words(text):
    return len(re.findall(r"\w+", text))


def line(values):
    return "| " + " | ".join(" ".join(v.replace("\\", "\\\\").replace("|", "\\|").split()) for v in values) + " |"


def brute(heads, rows, context, captions, budget):
    """Pieces by rendering whole candidates: (columns, [(row, {col: (start, end)}, {columns told})])."""
    out = []

    def measure(cols, shown):
        head = [" ".join(h[c] for h in heads if h[c]) for c in cols]
        texts = [context, *captions, *head, *(t for _, cells in shown for t in cells.values())]
        body = "\n".join([*captions, "| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in cols) + " |", *("| " + " | ".join(cells.get(c, "") for c in cols) + " |" for _, cells in shown)])
        return sum(map(words, texts)), len(context) + 2 * bool(context) + len(body)

    def fits(cols, shown, most=None):
        t, n = measure(cols, shown)
        return t <= (budget.target if most is None else most) and n <= budget.chars

    def whole(cols, r):
        return (r, {c: rows[r][c] for c in cols})

    def pack(cols):
        everything = [whole(cols, r) for r in range(len(rows))]
        if fits(cols, everything):
            out.append((cols, everything, {r: {c: (0, len(rows[r][c])) for c in cols} for r in range(len(rows))}))
            return
        if len(cols) > 2 and not fits(cols, [(0, {})]):
            held = cols[:1]
            for c in cols[1:]:
                if len(held) > 1 and not all(fits([*held, c], [whole([*held, c], r)]) for r in range(len(rows))):
                    pack(held)
                    held = cols[:1]
                held = [*held, c]
            pack(held)
            return
        pending = []

        def flush():
            if pending:
                out.append((cols, [whole(cols, r) for r in pending], {r: {c: (0, len(rows[r][c])) for c in cols} for r in pending}))
                pending.clear()

        for r in range(len(rows)):
            if fits(cols, [whole(cols, r)]):
                if pending and not fits(cols, [whole(cols, x) for x in [*pending, r]]):
                    flush()
                pending.append(r)
                continue
            flush()
            for c in cols:
                text = rows[r][c]
                if not text:
                    continue
                both = {cols[0]: rows[r][cols[0]], c: text}
                if fits(cols, [(r, both)]):
                    out.append((cols, [(r, both)], {r: {x: (0, len(both.get(x, ""))) for x in cols}}))
                    continue
                start = at = 0
                for atom in [a for a in re.split(r"(?<=[.!?。！？])(?=\s)", text) if a]:
                    assert fits(cols, [(r, {c: atom})], budget.most)
                    if at > start and not fits(cols, [(r, {c: text[start : at + len(atom)]})]):
                        out.append((cols, [(r, {c: text[start:at]})], {r: {c: (start, at)}}))
                        start = at
                    at += len(atom)
                out.append((cols, [(r, {c: text[start:at]})], {r: {c: (start, at)}}))
        flush()

    if rows:
        pack(list(range(len(rows[0]))))
    return out


@pytest.mark.parametrize("target,chars", [(14, 10_000), (30, 10_000), (1000, 150), (9, 10_000)])
def test_pieces_equal_brute_force(spark, target, chars):
    chance = random.Random(target)
    budget = Budget(target, 10_000, chars)
    tables, cells, notes = {}, [], []
    say = lambda n: " ".join(chance.choice(["alpha", "b|c", "delta.", "e\\f", "five!", "매출", "x"]) for _ in range(n))
    for t in range(40):
        width = chance.randrange(1, 6)
        heads = [[say(chance.randrange(3)) for _ in range(width)] for _ in range(chance.randrange(3))]
        rows = [[say(chance.choice([0, 1, 2, 6] if chars > 1000 else [0, 1, 2])) for _ in range(width)] for _ in range(chance.randrange(0, 7))]
        context, captions = chance.choice(["", "Acme FY2024"]), chance.choice([[], ["(단위 : 원)"]])
        tables[t] = (heads, rows, context, captions)
        for r, row in enumerate(heads + rows):
            for c, text in enumerate(row):
                at = 1000 * r + 50 * c
                cells.append((t, r, c, r < len(heads), text or chance.choice(["", None]), None if (t % 5, r, c) == (1, 2, 0) else [(at, at + 50)], "clash"))
        notes.append((t, context or None, [(c, 1, 2) for c in captions]))
    chance.shuffle(cells)
    cells, notes = spark.createDataFrame(cells, CELLS), spark.createDataFrame(notes, NOTES)
    told = X.pack(cells, ["doc_id"], notes, budget).select("doc_id", "piece", X.markdown().alias("body"), X.cell_spans().alias("spans")).collect()
    got = {(r.doc_id, r.piece): r.body for r in told}
    spans = {(r.doc_id, r.piece): r.spans and [tuple(s) for s in r.spans] for r in told}
    want, want_spans, many = {}, {}, 0
    for t, (heads, rows, context, captions) in tables.items():
        told = brute(heads, rows, context, captions, budget)
        many += len(told) > 1
        for k, (cols, shown, held) in enumerate(told):
            head = line([" ".join(h[c] for h in heads if h[c]) for c in cols])
            want[t, k] = "\n".join([*captions, head, line(["---"] * len(cols)), *(line([cells_.get(c, "") for c in cols]) for _, cells_ in shown)])
            places = {(len(heads) + r, c) for r, mine in held.items() for c in mine} | {(h, c) for h in range(len(heads)) for c in cols if heads[h][c]}
            missing = any((t % 5, r, c) == (1, 2, 0) for r, c in places)
            want_spans[t, k] = None if missing else sorted({(1000 * r + 50 * c, 1000 * r + 50 * c + 50) for r, c in places} | ({(1, 2)} if captions else set()))
        # every character of every cell is in a piece
        for r, row in enumerate(rows):
            for c, text in enumerate(row):
                assert sum(e - s for s, e in {m[2][r][c] for m in told if r in m[2] and c in m[2][r]}) >= len(text)
    assert got == want and spans == want_spans and many


def test_a_sentence_beyond_the_bound_raises(spark):
    cells = spark.createDataFrame([(1, 0, 0, False, "one two three four", None, "")], CELLS)
    with pytest.raises(Exception, match="fits nowhere"):
        X.pack(cells, ["doc_id"], budget=Budget(2, 3, 100)).count()


def test_no_cells_and_hits(spark):
    from pyspark.sql import functions as F

    assert X.pack(spark.createDataFrame([], CELLS), ["doc_id"]).count() == 0
    hits = spark.createDataFrame([(1, "table"), (2, "text"), (3, "table"), (1, "table")], "chunk_id long, kind string")
    fragments = spark.createDataFrame([(1, [(0, 30), (10, 40)]), (2, [(0, 9)]), (3, None), (4, [(0, 1)])], f"chunk_id long, spans {X.SPANS}")
    got = X.spans_of_hits(hits, fragments).withColumn("share", X.covered_share(F.col("spans"), F.lit(0), F.lit(100))).collect()
    assert [(r.chunk_id, r.share) for r in got] == [(1, 0.4)]
