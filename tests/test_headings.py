import random
import re

from pyspark.sql import functions as F

from lodestone.operators import headings as H

BLOCKS = "doc_id int, block_no int, text string, font_weight int, font_size double, in_table boolean"


def rule(blocks):
    named = [k for k, b in enumerate(blocks) if b[2] and len(b[2]) <= 300 and re.match(H.ITEM, b[2])]
    bold = [blocks[k] for k in named if blocks[k][3] >= 700]
    outside = [b for b in bold if not b[5]]
    hits, tables = (outside, False) if len(outside) >= 15 else (bold, True)
    if tables and (len(hits) < 5 or len(named) >= 10 and named[-1] - named[0] < len(blocks) * 0.15):
        return None
    return min(b[3] for b in hits), min(b[4] for b in hits), tables


def test_rules_and_headings_equal_brute_force(spark):
    chance = random.Random(6)
    rows, rules, found = [], {}, set()
    for doc in range(120):
        dense, share = chance.random() < 0.3, chance.choice([0.1, 0.3, 0.6])
        mine = []
        for k in range(chance.choice([0, 8, 40, 90])):
            item = chance.random() < share and (not dense or k < 12)
            text = chance.choice(["Item 7A. Risk", "ITEM 1 - Business", " item 16: x", "Item 9" + " y" * 200]) if item else chance.choice(["Items 7", "Item 17", None, "text", "Item"])
            mine.append((doc, k * 2, text, chance.choice([400, 700, 900]), chance.choice([8.0, 10.0, 12.5]), chance.random() < chance.choice([0.1, 0.8])))
        rows += mine
        if mine and (r := rule(mine)):
            rules[doc] = r
            found |= {(doc, b[1], {"Item 7A. Risk": "7A", "ITEM 1 - Business": "1", " item 16: x": "16", "Item 17": "1"}.get(b[2], "9")) for b in mine if b[2] and re.match(H.ITEM, b[2]) and b[3] >= r[0] and b[4] >= r[1] and (r[2] or not b[5])}
    chance.shuffle(rows)
    blocks = spark.createDataFrame(rows, BLOCKS)
    told = H.number_rules(blocks)
    assert {r.doc_id: (r.font_weight, r.font_size, r.in_table) for r in told.collect()} == rules
    assert {x[2] for x in rules.values()} == {True, False} and len(rules) < 120
    items = blocks.select("doc_id", "block_no", H.item_number(F.col("text")).alias("item")).where("item IS NOT NULL")
    assert {tuple(r) for r in H.headings(blocks, items, told).collect()} == found


def test_titles(spark):
    titles = spark.createDataFrame([("1A", "Risk Factors", 1), ("1B", "Unresolved Staff Comments", 2), ("2", "Properties", 3), ("7", "Management's Discussion and Analysis", 4), ("8", "Unresolved Staff Matters", 5)], "item string, title string, place int")
    cases = {"RISK FACTORS.": "1A", "Risk": None, "Risk Factors and more": None, "Unresolved staff": "1B", "Unresolve": "1B", "Unresol": None, "PROPERTIES": "2", "Properties of x": None, "Management’s Discussion": "7", "Management discussion": None, "managements discus": "7", None: None, "Unresolved Staff Matters": "1B"}
    texts = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    got = {r.k: r.item for r in H.canonical_items(texts, titles, ["k"]).collect()}
    assert {t: got.get(k) for k, t in enumerate(cases)} == cases
    own = spark.createDataFrame([(1, "A", "Our Capital ", 1), (1, "B", "our capital", 0), (2, "C", "Other", 0)], "doc_id int, item string, title string, place int")
    texts = spark.createDataFrame([(1, 5, "OUR CAPITAL"), (2, 6, "our capital"), (2, 7, " other\n")], "doc_id int, block_no int, text string")
    assert {tuple(r) for r in H.custom_items(texts, own, ["doc_id", "block_no"]).collect()} == {(1, 5, "B"), (2, 7, "C")}


def test_styles(spark):
    rows = [("font-weight:bold;font-size:10.5pt", "div", 700, 10.5), ("font-weight: 600", "p", 600, 0.0), (None, "p", 400, 0.0), ("font-weight:300", "h2", 700, 0.0), ("font-size:9pt", "b", 700, 9.0)]
    df = spark.createDataFrame(rows, "style string, tag string, weight int, size double")
    got = df.select(H.font_weight(F.col("style"), F.col("tag")) == F.col("weight"), H.font_size(F.col("style")) == F.col("size")).collect()
    assert all(all(r) for r in got)
