import random
import re

from lodestone.operators import grids as G

CELLS = "doc_id int, row_no int, cell_no int, text string, rowspan int, colspan int, align string, start_char long, end_char long, c string"
BOTH = re.compile(f"{G.UNIT}|{G.DATE}")


def annotates(text):
    found = BOTH.findall(text)
    return not BOTH.sub("", text).strip() and any(re.fullmatch(G.UNIT, f) for f in found)


def heads(grid):
    n, labelled = 0, False
    for row in grid:
        if not any(row[1:]) or any(c and (re.match(G.DASH, c) or re.match(G.NUMBER, c) and not re.match(G.PERIOD, c)) for c in row) or row[0] and labelled:
            break
        labelled = labelled or bool(row[0])
        n += 1
    return 0 if n == len(grid) else n


def brute(rows):
    """One table on a matrix: (captions, [(source row, header, [(text, spans)])])."""
    places, spread, until, width = {}, [], {}, 0
    source = []
    for r, row in enumerate(rows):
        c = 0
        for text, down, across, align, span in row:
            text = (text or "").strip()
            while until.get(c, -1) >= r:
                c += 1
            source.append((r, c, down, across, text, span))
            if align == "center" and across > 1 and text:
                spread.append((r, c, across, text))
            elif text:
                places[r, c + across - 1 if align == "right" else c] = text
            if down > 1:
                for k in range(c, c + across):
                    until[k] = max(until.get(k, -1), r + down - 1)
            c += across
            width = max(width, c)
    full = {c for _, c in places}
    for r, c, across, text in spread:
        for k in [k for k in range(c, c + across) if k in full] or [c]:
            places[r, k] = text
    said = {r: [places[r, c] for c in range(width) if (r, c) in places] for r in range(len(rows))}
    alone = annotates(" ".join(t for r in said for t in said[r]))
    notes = [r for r in said if said[r] and (alone or annotates(" ".join(said[r])))]
    captions = list(dict.fromkeys(BOTH.findall(" ".join(t for r in notes for t in said[r]))))
    kept = [r for r in said if said[r] and r not in notes]
    cols = [c for c in range(width) if any((r, c) in places for r in kept)]
    grid = [[places.get((r, c), "") for c in cols] for r in kept]
    member = [[c] for c in cols]
    gone, takes, n = set(), set(), heads(grid)
    for c in range(len(cols)):
        marks = [(i, grid[i][c]) for i in range(n, len(grid)) if grid[i][c]]
        left, right = (c - 1 if c and c - 1 not in gone else None), (c + 1 if c + 1 < len(cols) else None)
        if c in takes or not marks or any(m not in G.MARKERS for _, m in marks) or (left is None and right is None):
            continue
        to = set()
        for i, m in marks:
            first, second = (left, right) if m == "%" else (right, left)
            t = second if first is None else first
            to.add(t)
            v = grid[i][t]
            grid[i][t] = m if not v else f"{v} %" if m == "%" else f"{m} {v}"
        for i in range(n):
            for t in to if grid[i][c] else ():
                order = (grid[i][c], grid[i][t]) if c < t else (grid[i][t], grid[i][c])
                grid[i][t] = " ".join(dict.fromkeys(x for x in order if x))
        for t in to:
            member[t] = member[t] + member[c]
        gone.add(c)
        takes |= to
    stay = [c for c in range(len(cols)) if c not in gone]
    grid = [[row[c] for c in stay] for row in grid]
    n = heads(grid)
    spans = lambda r, cs: sorted({s[5] for s in source if s[0] <= r < s[0] + s[2] and any(s[1] <= c < s[1] + s[3] for c in cs)})
    return captions, [(r, i < n, [(t, spans(r, member[c])) for t, c in zip(row, stay, strict=True)]) for i, (r, row) in enumerate(zip(kept, grid, strict=True))]


def test_grids_equal_a_matrix(spark):
    chance = random.Random(9)
    data, want, captions = [], {}, {}
    texts = ["", " ", None, "Sales", "Net income", "2024", "1,234", "(5.0)", "-", "$", "%", "$", "%", "₩", "(단위 : 원)", "(기준일 : 2024년 1월 5일)"]
    for doc in range(250):
        at, rows = 0, []
        for r in range(chance.randrange(0, 6)):
            row = []
            if chance.random() < 0.15:
                row = [("(단위 : 백만원)", 1, chance.choice([1, 3]), None, (at, at + 5))] + ([("(기준일 : 2024년 12월 31일)", 1, 1, None, (at + 5, at + 9))] if chance.random() < 0.5 else [])
                at += 9
            else:
                for c in range(chance.randrange(0, 6)):
                    text = chance.choice(["Year", "2023", "Label", ""]) if r == 0 and chance.random() < 0.7 else chance.choice(texts)
                    row.append((text, chance.choice([1, 1, 1, 2]), chance.choice([1, 1, 1, 2, 3]), chance.choice([None, "right", "center", "left"]), (at, at + 3)))
                    at += 3
            rows.append(row)
            data += [(doc, r, n, *x[:4], *x[4], "clash") for n, x in enumerate(row)]
        notes, told = brute(rows)
        if notes:
            captions[doc] = notes
        for r, header, row in told:
            want |= {(doc, r, c): (header, text, spans) for c, (text, spans) in enumerate(row) if text or spans}
    chance.shuffle(data)
    own, notes = G.structured(spark.createDataFrame(data, CELLS), ["doc_id"])
    got = {(r.doc_id, r.row_no, r.col): (r.header, r.text, [tuple(s) for s in r.sources]) for r in own.collect()}
    assert {r.doc_id: [c.text for c in r.captions] for r in notes.collect()} == captions
    assert got == want
    assert any(h for h, _, _ in want.values()) and any(" %" in t for _, t, _ in want.values()) and any("$ " in t for _, t, _ in want.values())


def test_no_cells(spark):
    own, notes = G.structured(spark.createDataFrame([], CELLS), ["doc_id"])
    assert own.count() == notes.count() == 0
