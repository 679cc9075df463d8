import random
import re
from collections import Counter

import pytest

from lodestone.operators import crossrefs as C

ROWS = "doc_id int, row_no int, cells array<string>, entry string"
ITEM, EMPTY, REF, NOTE = (re.compile(x) for x in (C.ITEM, C.EMPTY, C.REFERENCE, C.NOTE))


def spans(text):
    out = []
    for a, b in re.findall(r"(?<!\d)(\d{1,3})(?:\s*-\s*(\d{1,3}))?(?!\d)", text or ""):
        out.append((min(int(a), int(b or a)), max(int(a), int(b or a))))
    return out


def scan(rows):
    """One pass over the rows with the entry in hand."""
    out, notes, cur, closed = [], {}, None, True
    for cells in rows:
        if not cells:
            continue
        last, says = cells[-1], lambda t: bool(spans(t) or EMPTY.match(t) or REF.match(t))
        if m := ITEM.match(cells[0]):
            cur = {"item": (m[1] + (m[2] or "")).upper(), "title": (cells[1] if len(cells) > 1 else "").rstrip(":").strip(), "spans": [], "status": "parsed", "ref": None}
            out.append(cur)
            tail = cells[2] if len(cells) > 2 else ""
            closed = says(tail)
            go_on = False
        elif cur and not closed and (len(cells) >= 2 or says(last)):
            tail, go_on = last, True
        else:
            if (m := NOTE.match(cells[0])) and len(cells[0]) > 8:
                notes[m[1].lower()] = m[2].strip()
            continue
        if EMPTY.match(tail):
            cur["status"] = "empty_disclosure"
            closed = closed or go_on
        elif m := REF.match(tail):
            cur["status"], cur["ref"] = "incorporated_by_reference", m[1].lower()
        cur["spans"] += spans(tail)
    for e in out:
        e["ref"] = notes.get(e["ref"], e["ref"])
        if e["spans"]:
            e["status"] = "parsed"
        elif e["status"] == "parsed" or EMPTY.match(e["title"]):
            e["status"] = "empty_disclosure"
    return [(k + 1, e["item"], e["title"], e["spans"], e["status"], e["ref"]) for k, e in enumerate(out)]


def test_entries_equal_a_pass_with_state(spark):
    chance = random.Random(4)
    data, want = [], {}
    for doc in range(150):
        rows = []
        for _ in range(chance.randrange(0, 18)):
            tail = chance.choice(["53-67", "70", "7, 19-25", "Not applicable", "N/A.", "(a)", " (B) ", "none", "see there", "88 - 86"])
            item = chance.choice(["Item 1.", "ITEM 1a", "Item 16 .", "item 7"])
            rows.append(chance.choice([[item, "Business:", tail], [item, "Reserved"], [item], [item, "Not applicable"], ["Liquidity", tail], [tail], ["Signatures", "Page 125"], ["(a) Incorporated by reference to the proxy"], ["(b) x"], ["(b)\nLong enough note"], ["free text"], []]))
        data += [(doc, n, r, "clash") for n, r in enumerate(rows)]
        want[doc] = scan(rows)
    chance.shuffle(data)
    got = {}
    for r in C.entries(spark.createDataFrame(data, ROWS)).orderBy("doc_id", "entry").collect():
        got.setdefault(r.doc_id, []).append((r.entry, r.item, r.title, [tuple(s) for s in r.spans], r.status, r.reference))
    assert got == {k: v for k, v in want.items() if v}
    assert {x[4] for v in want.values() for x in v} == {"parsed", "empty_disclosure", "incorporated_by_reference"}


def plain(s):
    return re.sub("[^a-z0-9 ]", "", (s or "").lower()).strip()


def said(s):
    return {re.sub("s+$", "", w) for w in plain(s).split() if w not in C.SILENT and len(w) > 2}


def test_titles_in_order_equal_a_walk(spark):
    chance = random.Random(8)
    words = ["Risk", "Risks", "Factors", "of", "the", "Business", "Capital", "Notes", "to", "Market's", "an"]
    say = lambda: " ".join(chance.choice(words) for _ in range(chance.randrange(0, 4)))
    blocks, titles, want = [], [], set()
    for doc in range(160):
        body = [(chance.choice([say(), say().upper() + ".", None, "risk factors " * 12]), chance.random() < 0.15) for _ in range(chance.randrange(0, 40))]
        blocks += [(doc, j, t, s) for j, (t, s) in enumerate(body)]
        cursor = 0
        for k in range(chance.randrange(0, 12)):
            title = say()
            titles.append((doc, k, title, k * 3))
            open_ = [j for j in range(cursor, len(body)) if not body[j][1] and len(plain(body[j][0])) < 120]
            hit = next((j for j in open_ if plain(body[j][0]) == plain(title) and plain(title)), None)
            if hit is None and said(title):
                hit = next((j for j in open_ if said(body[j][0]) == said(title)), None)
            if hit is not None:
                want.add((doc, k, title, k * 3, hit))
                cursor = hit + 1
    chance.shuffle(blocks)
    blocks = spark.createDataFrame(blocks, "doc_id int, block_no int, text string, skip boolean")
    got = C.located(spark.createDataFrame(titles, "doc_id int, row_no int, title string, page long"), blocks)
    assert {(r.doc_id, r.row_no, r.title, r.page, r.block_no) for r in got.collect()} == want and len(want) > 50


INDEX = f"doc_id int, entry int, item string, title string, spans {C.SPANS}, status string, reference string"


def test_items_of_pages_and_missing(spark):
    index = spark.createDataFrame([(1, 1, "7", "Management discussion", [(5, 6), (19, 44)], "parsed", None), (1, 2, "7A", "Market risks", [(40, 44)], "parsed", None), (1, 3, "8", "Statements", [(60, 200), (42, 43)], "parsed", None), (1, 4, "9", "Gone", [(1, 300)], "empty_disclosure", None), (1, 5, "3", "Legal proceedings", [], "parsed", None), (1, 6, "4", "Mine", [(250, 250)], "parsed", None)], INDEX)
    points = spark.createDataFrame([(1, 5, "x", 9), (1, 42, "", 9), (1, 42, "The market risk", 9), (1, 42, "Management's discussion", 9), (1, 130, "x", 9), (1, 300, "x", 9), (2, 5, "x", 9), (1, 42, "", 9)], "doc_id int, page long, title string, extra int")
    got = Counter((r.doc_id, r.page, r.title, r.extra, r.item) for r in C.items_of_pages(points, index).collect())
    assert got == Counter([(1, 5, "x", 9, "7"), (1, 42, "", 9, "8"), (1, 42, "", 9, "8"), (1, 42, "The market risk", 9, "7A"), (1, 42, "Management's discussion", 9, "7"), (1, 130, "x", 9, "8")])
    blocks = spark.createDataFrame([(1, 3, "LEGAL PROCEEDINGS", True), (1, 5, "Legal Proceedings.", False), (1, 9, "legal proceedings", None), (1, 2, "mine", False), (2, 1, "statements", False)], "doc_id int, block_no int, text string, skip boolean")
    taken = spark.createDataFrame([(1, "7"), (1, "8")], "doc_id int, item string")
    assert [tuple(r) for r in C.missing(index, taken, blocks).select("item", "page", "block_no").collect()] == [("3", 0, 5)]


def test_tables_contents_and_segments(spark):
    rows = [(1, 0, k, c) for k, c in enumerate([["Contents", "Page"], *([f"Title {k}", f"{k} {k}"] for k in range(9)), ["Page", "7"], [" Late ", "99"], []])]
    rows += [(1, t, k, [f"Item {k + 1}.", "x", "3"]) for t in (3, 5) for k in range(5)] + [(1, 4, k, ["a", "1"]) for k in range(30)]
    rows = spark.createDataFrame(rows, "doc_id int, table_no int, row_no int, cells array<string>")
    assert {tuple(r) for r in C.told_tables(rows).collect()} == {(1, "contents", 0), (1, "index", 5)}
    got = C.contents(rows.where("table_no = 0")).collect()
    assert [(r.title, r.page) for r in got if r.row_no > 8] == [("Title 8", 88), ("Late", 99)] and len(got) == 10
    # pages end at footers: the stretch of item 1 stops at the footer of its last page, and item 8 has the rest
    index = spark.createDataFrame([(1, 1, "1", "Our business", [(3, 9)], "parsed", None), (1, 2, "8", "Accounts", [(10, 30)], "parsed", None), (1, 3, "3", "Legal proceedings", [(31, 31)], "parsed", None)], INDEX)
    blocks = spark.createDataFrame([(1, j, {2: "Our Business", 20: "Notes to accounts", 26: "Legal Proceedings"}.get(j, f"text {j}"), False) for j in range(30)], "doc_id int, block_no int, text string, skip boolean")
    titles = spark.createDataFrame([(1, 0, "Our business", 3), (1, 1, "Notes to the accounts", 25), (1, 2, "Nowhere", 40)], "doc_id int, row_no int, title string, page long")
    footers = spark.createDataFrame([(1, 6, 5), (1, 12, 9), (1, 18, 10)], "doc_id int, block_no int, page int")
    got = sorted(tuple(r) for r in C.segments(titles, index, blocks, footers).select("low", "high", "item", "title").collect())
    assert got == [(2, 13, "1", "Our business"), (13, 20, "8", ""), (20, 26, "8", "Notes to the accounts"), (26, 30, "3", "Legal proceedings")]


def test_no_rows(spark):
    assert C.entries(spark.createDataFrame([], ROWS)).count() == 0
    assert C.located(spark.createDataFrame([], "doc_id int, row_no int, title string, page long"), spark.createDataFrame([], "doc_id int, block_no int, text string, skip boolean")).count() == 0
