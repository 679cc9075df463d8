"""Cross-references of filings: index and contents tables, titles found in the body in order, items of pages, and the sections
that follow from them."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parsing import page_ranges

#: What index cells look like, words that say nothing in a title, and the sizes that tell tables and titles apart.
ITEM = r"(?i)^item\s+(1[0-6]|[1-9])([A-C])?\s*\.?$"
EMPTY = r"(?i)^\s*(not applicable|none|n/?a|\[?reserved\]?)\.?\s*$"
REFERENCE = r"(?i)^\s*\(([a-z])\)\s*$"
NOTE = r"(?s)^\(([a-z])\)\s*(.+)$"
SILENT = ["and", "of", "the", "for", "to", "in", "our", "about", "on", "a", "with"]
INDEX_ROWS, CONTENTS_ROWS, HEAD_ROWS, NOTE_CHARS, TITLE_CHARS, LEAST_CHARS, ORPHAN_BLOCKS = 5, 10, 3, 8, 120, 8, 3
SPANS = "array<struct<low:int,high:int>>"


def plain(text: Column) -> Column:
    """A title for comparison: lower case, ASCII letters, digits and blanks only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", ""))


def title_words(text: Column) -> Column:
    """The sorted distinct words of a title that say something, without a plural's s."""
    said = F.filter(F.split(plain(text), " +"), lambda w: (F.length(w) > 2) & ~w.isin(SILENT))
    return F.array_sort(F.array_distinct(F.transform(said, lambda w: F.regexp_replace(w, "s+$", ""))))


def _is(cell: Column, pattern: str) -> Column:
    return F.coalesce(cell.rlike(pattern), F.lit(False))


def _number(cells: Column) -> Column:
    """The page number in a row's last cell, blanks within it left out; null if there is none."""
    last = F.replace(F.element_at(cells, -1), F.lit(" "), F.lit(""))
    return F.when(last.rlike("^[0-9]+$"), last.try_cast("bigint"))


def told_tables(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, table_no) of each document's `index`, the last table with INDEX_ROWS rows that hold an item's cell, and
    `contents`, the first other one with CONTENTS_ROWS rows that end in a page number, under a row of the first HEAD_ROWS that ends
    in "page". rows: (key, table_no, row_no, cells) without empty cells; a row without cells counts for nothing."""
    place = F.row_number().over(Window.partitionBy(key, "table_no").orderBy("row_no"))
    some = rows.where(F.size("cells") > 0).withColumn("place", place)
    shape = some.groupBy(key, "table_no").agg(
        F.count_if(F.exists("cells", lambda c: _is(c, ITEM))).alias("items"),
        F.count_if((F.size("cells") >= 2) & _number(F.col("cells")).isNotNull()).alias("pages"),
        F.bool_or((F.col("place") <= HEAD_ROWS) & (F.lower(F.element_at("cells", -1)) == "page")).alias("headed"),
    )
    kind = F.when(F.col("items") >= INDEX_ROWS, "index").when(F.col("headed") & (F.col("pages") >= CONTENTS_ROWS), "contents")
    one = F.when(F.col("kind") == "index", F.max("table_no")).otherwise(F.min("table_no"))
    return shape.select(key, "table_no", kind.alias("kind")).where("kind IS NOT NULL").groupBy(key, "kind").agg(one.alias("table_no"))


def contents(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row_no, title, page) of the rows (key, row_no, cells) of a contents table that name a page."""
    title = F.trim(F.col("cells")[0])
    told = rows.where(F.size("cells") >= 2).select(key, "row_no", title.alias("title"), _number(F.col("cells")).alias("page"))
    return told.where("page IS NOT NULL AND title <> ''").where(~F.startswith(F.lower("title"), F.lit("page")))


def entries(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entry, item, title, spans, status, reference): the items of an index table, in order from 1.

    rows: (key, row_no, cells) without empty cells. A row whose first cell is an item begins an entry; its third cell is the
    value. An entry without one takes the last cells of the rows below that hold a value or two cells, up to the first that says
    that there is nothing. Other rows may be notes, `(a)` and what it stands for, the last of each letter. An entry with pages is
    parsed; else the last of its values decides, incorporated_by_reference with the note's text, or empty_disclosure.

    Which rows an entry takes follows from counts over the rows before, so no row waits for another one's result.
    """
    order = Window.partitionBy(key).orderBy("row_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    cells = F.col("cells")
    spans = lambda c: page_ranges(F.coalesce(c, F.lit(""))).cast(SPANS)
    says = lambda c: (F.size(spans(c)) > 0) | _is(c, EMPTY) | _is(c, REFERENCE)
    last = F.element_at("cells", -1)
    told = rows.where(F.size("cells") > 0).withColumn("is_item", _is(cells[0], ITEM))
    told = told.withColumns({"entry": F.sum(F.col("is_item").cast("int")).over(so_far), "value": F.when(F.col("is_item"), F.coalesce(F.get(cells, F.lit(2)), F.lit(""))).otherwise(last)})
    within = Window.partitionBy(key, "entry").orderBy("row_no")
    told = told.withColumns({"closed": F.first(says(F.col("value"))).over(within), "fits": ~F.col("is_item") & ((F.size("cells") >= 2) | says(last))})
    ended = F.coalesce(F.sum((F.col("fits") & _is(F.col("value"), EMPTY)).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    told = told.withColumn("taken", F.col("is_item") | ((F.col("entry") > 0) & ~F.col("closed") & F.col("fits") & ~ended))
    noted = told.where(~F.col("taken") & _is(cells[0], NOTE) & (F.length(cells[0]) > NOTE_CHARS))
    notes = noted.groupBy(key, F.regexp_extract(cells[0], NOTE, 1).alias("letter")).agg(F.max_by(F.trim(F.regexp_extract(cells[0], NOTE, 2)), "row_no").alias("note"))
    value = F.col("value")
    letter = F.when(_is(value, REFERENCE) & ~_is(value, EMPTY), F.lower(F.regexp_extract(value, REFERENCE, 1)))
    state = F.when(_is(value, EMPTY), "empty_disclosure").when(letter.isNotNull(), "incorporated_by_reference")
    code = F.upper(F.concat(F.regexp_extract(cells[0], ITEM, 1), F.regexp_extract(cells[0], ITEM, 2)))
    title = F.trim(F.regexp_replace(F.coalesce(F.get(cells, F.lit(1)), F.lit("")), ":+$", ""))
    in_order = lambda of: F.array_sort(F.collect_list(F.when(of.isNotNull(), F.struct("row_no", of.alias("x")))))
    one = told.where("taken").groupBy(key, "entry").agg(
        F.max(F.when(F.col("is_item"), code)).alias("item"), F.max(F.when(F.col("is_item"), title)).alias("title"),
        F.flatten(F.transform(in_order(spans(value)), lambda s: s["x"])).alias("spans"), F.try_element_at(in_order(state), F.lit(-1))["x"].alias("state"), F.try_element_at(in_order(letter), F.lit(-1))["x"].alias("letter"),
    )
    status = F.when(F.size("spans") > 0, "parsed").when(F.col("state").isNull() | _is(F.col("title"), EMPTY), "empty_disclosure").otherwise(F.col("state"))
    return one.join(notes, [key, "letter"], "left").select(key, "entry", "item", "title", "spans", status.alias("status"), F.coalesce("note", "letter").alias("reference"))


def located(titles: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row_no, title, page, block_no): where the body has the titles of the contents, each after the one before it.

    titles: (key, row_no, title, page); blocks: (key, block_no, text, skip), `skip` marking what is no body. A title is met by the
    first later block of under TITLE_CHARS characters with the same plain text, else by the first with the same words. A title
    that nothing meets, or that has no plain text, is passed over. Joins on plain text and on words tell each title's places; only their numbers go through
    the walk down a document's titles, which finds the next place by bisection.
    """
    short = blocks.where(~F.coalesce("skip", F.lit(False))).select(key, "block_no", plain(F.col("text")).alias("plain"), F.array_join(title_words(F.col("text")), " ").alias("words")).where(F.length("plain") < TITLE_CHARS)
    asked = titles.select(key, "row_no", plain(F.col("title")).alias("plain"), F.array_join(title_words(F.col("title")), " ").alias("words"))
    places = lambda on, kind: asked.where(F.col(on) != "").join(short.select(key, "block_no", on), [key, on]).groupBy(key, "row_no").agg(F.array_sort(F.collect_list("block_no")).alias(kind))
    found = titles.select(key, "row_no").join(places("plain", "exact"), [key, "row_no"], "left").join(places("words", "same"), [key, "row_no"], "left").where("exact IS NOT NULL OR same IS NOT NULL")

    @F.pandas_udf("array<int>")
    def walked(exact: pd.Series, same: pd.Series) -> pd.Series:
        def walk(exacts: list, sames: list) -> list[int | None]:
            cursor, out = 0, []
            for places_of in zip(exacts, sames, strict=True):
                hits = (p[at] for p in places_of if p is not None and (at := bisect_left(p, cursor)) < len(p))
                hit = next(hits, None)
                cursor = cursor if hit is None else int(hit) + 1
                out.append(None if hit is None else int(hit))
            return out

        return pd.Series([walk(list(e), list(s)) for e, s in zip(exact, same, strict=True)])

    one = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_no", "exact", "same"))).alias("of"))
    told = one.withColumn("hits", walked("of.exact", "of.same"))
    hits = told.select(key, F.explode(F.arrays_zip(F.col("of.row_no").alias("row_no"), "hits")).alias("h")).select(key, "h.row_no", F.col("h.hits").alias("block_no"))
    return titles.select(key, "row_no", "title", "page").join(hits.where("block_no IS NOT NULL"), [key, "row_no"])


def items_of_pages(points: DataFrame, index: DataFrame, key: str = "doc_id", width: int = 64) -> DataFrame:
    """points (key, page, title, ...) with `item`, the best of the parsed entries with a range that covers the page: that which
    shares most words with the title, then the narrowest range, the shortest code, the first entry. Pages that none covers are
    left out. Ranges and pages meet in blocks of `width` pages, so that long indexes are not held against all pages."""
    ranges = index.where("status = 'parsed'").select(key, "entry", "item", F.col("title").alias("told"), F.explode("spans").alias("s"))
    ranges = ranges.select(key, "entry", "item", title_words(F.col("told")).alias("told"), "s.low", "s.high", F.explode(F.sequence(F.floor(F.col("s.low") / width), F.floor(F.col("s.high") / width))).alias("part"))
    rows = points.withColumn("point", F.monotonically_increasing_id())
    asked = points.select(key, "page", "title").distinct().withColumn("part", F.floor(F.col("page") / width))
    hit = asked.join(ranges, [key, "part"]).where((F.col("low") <= F.col("page")) & (F.col("page") <= F.col("high")))
    worth = F.struct((-F.size(F.array_intersect(title_words(F.col("title")), "told"))).alias("o"), (F.col("high") - F.col("low")).alias("w"), F.length("item").alias("l"), "entry")
    best = hit.groupBy(key, "page", "title").agg(F.min_by("item", worth).alias("item"), F.min(F.struct(worth.alias("worth"), "item"))["item"].alias("first"))
    named = best.select(F.col(key).alias("of"), F.col("page").alias("at"), F.col("title").alias("called"), F.col("first").alias("item"))
    return rows.drop("point").join(named, (F.col(key) == F.col("of")) & (F.col("page") == F.col("at")) & F.col("title").eqNullSafe(F.col("called"))).drop("of", "at", "called")


def missing(index: DataFrame, assigned: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item, title, page, block_no): parsed entries whose item no located title has, found in the body by their own title of
    LEAST_CHARS characters or more; the first block that isn't skipped. page is the first of the entry's ranges, or 0."""
    open_ = index.where("status = 'parsed'").join(assigned.select(key, "item").distinct(), [key, "item"], "left_anti").withColumn("plain", plain(F.col("title"))).where(F.length("plain") >= LEAST_CHARS)
    body = blocks.where(~F.coalesce("skip", F.lit(False))).select(key, "block_no", plain(F.col("text")).alias("plain"))
    firsts = body.join(open_.select(key, "plain").distinct(), [key, "plain"], "left_semi").groupBy(key, "plain").agg(F.min("block_no").alias("block_no"))
    return open_.join(firsts, [key, "plain"]).select(key, "entry", "item", "title", F.coalesce(F.get("spans", F.lit(0))["low"], F.lit(0)).cast("bigint").alias("page"), "block_no")


def segments(titles: DataFrame, index: DataFrame, blocks: DataFrame, footers: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item, title, low, high): the stretches [low, high) of blocks of each item.

    titles: located ones' contents (key, row_no, title, page); footers: (key, block_no, page). Located titles take the item of their
    page, entries without one are looked for by title, and each stretch ends where the next title stands. If the page range of the
    item ends before, at a footer, and the next title is more than a page behind it, the stretch ends at the footer, and the item
    of the page after it has the rest, if that is ORPHAN_BLOCKS blocks or more.
    """
    found = located(titles, blocks, key)
    named = found.join(items_of_pages(found.select(key, "row_no", "page", "title"), index, key).select(key, "row_no", "item"), [key, "row_no"], "left").select(key, "title", "page", "block_no", "item")
    taken = named.where("item IS NOT NULL")
    extra = missing(index, taken, blocks, key).join(taken.select(key, "block_no"), [key, "block_no"], "left_anti")
    extra = extra.groupBy(key, "block_no").agg(F.min(F.struct("entry", "title", "page", "item")).alias("x")).select(key, "x.title", "x.page", "block_no", "x.item")
    order = Window.partitionBy(key).orderBy("block_no", F.col("item").isNull(), "page")
    ends = blocks.groupBy(key).agg((F.max("block_no") + 1).alias("last"))
    rows = named.unionByName(extra).withColumns({"next_block": F.lead("block_no").over(order), "next_page": F.lead("page").over(order)}).join(ends, key).where("item IS NOT NULL")
    first = index.groupBy(key, "item").agg(F.min_by("spans", "entry").alias("spans"))
    covers = F.array_sort(F.transform(F.filter("spans", lambda s: (s["low"] <= F.col("page")) & (F.col("page") <= s["high"])), lambda s: F.struct((s["high"] - s["low"]).alias("w"), s["low"].alias("low"), s["high"].alias("high"))))
    rows = rows.join(first, [key, "item"]).withColumn("range_end", F.coalesce(F.get(covers, F.lit(0))["high"].cast("bigint"), F.col("page")))
    marks = footers.groupBy(key, F.col("page").cast("bigint").alias("range_end")).agg(F.max("block_no").alias("footer"))
    rows = rows.join(marks, [key, "range_end"], "left").withColumn("end", F.coalesce("next_block", "last"))
    cut = F.coalesce((F.col("block_no") < F.col("footer") + 1) & (F.col("footer") + 1 < F.col("end")) & (F.col("next_page") > F.col("range_end") + 1), F.lit(False))
    rows = rows.withColumn("cut", cut)
    own = rows.select(key, "item", "title", F.col("block_no").alias("low"), F.when(F.col("cut"), F.col("footer") + 1).otherwise(F.col("end")).alias("high"))
    rest = rows.where(F.col("cut") & (F.col("next_block") - F.col("footer") - 1 >= ORPHAN_BLOCKS)).select(key, (F.col("range_end") + 1).alias("page"), F.lit("").alias("title"), (F.col("footer") + 1).alias("low"), F.col("next_block").alias("high"))
    return own.unionByName(items_of_pages(rest, index, key).select(key, "item", "title", "low", "high"))
