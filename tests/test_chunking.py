import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking

SCHEMA = "doc_id long, section int, header string, text string"


def packed(text, header, target, chars):
    words = lambda t: len(re.findall(r"\w+", t))
    head, out = header + "\n\n" if header else "", []
    for s in re.split(r"(?<=[.!?。！？])(?=\s)|(?<=\n)(?=\n)", text):
        if not s:
            continue
        if out and words(head + out[-1] + s) <= target and len(head + out[-1] + s) <= chars:
            out[-1] += s
        else:
            out.append(s)
    return out


def test_pieces_are_as_by_hand(spark):
    text = "One two three. Four five! Six?  Seven eight nine ten eleven twelve. \n\n\nA. b. c. d. e. f. 끝. é ü.\nx y"
    rows = [(1, 0, "Head er", text), (1, 1, None, text), (2, 0, "", "no end"), (3, 0, "h", None), (4, 0, "h", "")]
    got = chunking.pieces(spark.createDataFrame(rows, SCHEMA), chunking.Budget(7, 20, 60)).collect()
    told = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.section, r.piece)):
        told.setdefault((r.doc_id, r.section), []).append(r.body)
    assert told == {(d, s): packed(t, h or "", 7, 60) for d, s, h, t in rows if t}
    assert "".join(told[1, 0]) == text and len(told[1, 0]) > 3


def test_a_sentence_that_fits_nowhere(spark):
    with pytest.raises(Exception, match="fits nowhere"):
        chunking.pieces(spark.createDataFrame([(1, 0, "", "a b c d e. f")], SCHEMA), chunking.Budget(2, 4, 100)).collect()
    with pytest.raises(ValueError):
        chunking.Budget(5, 4)
    with pytest.raises(ValueError, match="no lexical plan"):
        chunking.lexical_plan("de")
    texts = spark.createDataFrame([("",), (None,), ("a b",), ("a b c",), ("abcdefghijk",)], "t string")
    assert [r.x for r in texts.select(chunking.Budget(1, 2, 10).accepts(F.col("t")).alias("x")).collect()] == [False, False, True, False, False]


@pytest.mark.parametrize("blocks,message", [([(0, 5, 1), (4, 9, 1)], "out of order"), ([(0, 5, 1), (5, 9, 2)], "several source groups"), ([(3, 3, 1)], "without spans"), ([(None, 3, 1)], "without spans")])
def test_blocks_without_one_span(spark, blocks, message):
    df = spark.createDataFrame([(1, n, *b) for n, b in enumerate(blocks)], "g int, n int, start_char long, end_char long, source_group int")
    with pytest.raises(Exception, match=message):
        chunking.enclosing(df, ["g"], "n").collect()
    fine = spark.createDataFrame([(1, 0, 2, 5, 1), (1, 1, 7, 9, 1)], df.schema)
    assert [tuple(r) for r in chunking.enclosing(fine, ["g"], "n").collect()] == [(1, 2, 9)]


def test_headers_and_keys(spark):
    rows = spark.createDataFrame([("AMD", 2024, "Item 7", "MD&A", "Cash"), ("S", 2023, "I. 개요", "개요", None), ("S", 2023, None, None, "Cash"), ("S", 2023, "x", "t", "t")], "i string, y int, l string, t string, h string")
    got = [r.x for r in rows.select(chunking.context_header(chunking.citation(F.col("i"), F.col("y"), F.col("l")), F.col("t"), F.col("h")).alias("x")).collect()]
    assert got == ["AMD FY2024 · Item 7 · MD&A · Cash", "S FY2023 · I. 개요", "S FY2023 · Unnumbered section · Cash", "S FY2023 · x · t"]
    odd = [(1, 2, 'a "b"\n\t\\ 끝\x01', None), (None, 0, "", "x")]
    keys = spark.createDataFrame(odd, "a long, b long, c string, d string").select(chunking.stable_key(["a", "b"], ["c", "d"]).alias("k")).collect()
    assert [r.k for r in keys] == [hashlib.sha256(json.dumps(list(o), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for o in odd]
