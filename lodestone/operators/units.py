"""Units: a section's blocks grouped into text and table units that cross no source group, heading or table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import index_text

from .chunking import Budget, context_header, lexical_plan

#: Fixed value: a paragraph or cell that only says in which unit figures are.
UNIT_CAPTION = r"^\(\s*단위\s*[:：]?\s*[^)]*\)$"
DOT = " · "


def is_unit_caption(text: Column) -> Column:
    return F.coalesce(F.btrim(text, F.lit(" \t\r\n\x0b\x0c")).rlike(UNIT_CAPTION), F.lit(False))


def _ran(values: Column, before: Column) -> Column:
    """Whether this row's value differs from the one before it, nulls being equal; the first row counts."""
    return ~values.eqNullSafe(before)


def units(blocks: DataFrame, by: list[str], budget: Budget = Budget(), language: str = "en") -> DataFrame:
    """(by, unit_no, kind, body, heading, captions, start_char, end_char, n_blocks): units in source order, from 0 on.

    blocks: (by, block_no, kind, text, source_group, source_heading, captions, citation, title, start_char, end_char). kind is
    heading, text or table; a table's text is its rendering, empty where it holds captions only, and `captions` are its own
    unit captions. citation and title make the header that each unit is indexed under.

    A change of source group, a heading and a table end a text unit. Within these, paragraphs join up to the budget's target,
    header and blank lines between them included; one that is larger by itself is a unit by itself. Blank paragraphs count for
    nothing. Headings without a paragraph or table between them are one heading; a group without a heading of its own has its
    source_heading. A paragraph that is a unit caption, and a table of captions only, are no units: they go to the next table
    as part of its heading and as `captions` (text, start_char, end_char), unless a heading, another paragraph, another table
    or a new group comes first. A table's own captions are among its `captions` too.

    What holds at a block follows from counts of the barriers before it, by windows over one shuffle on `by`; only numbers of
    tokens and characters go through the packing loop, stretch by stretch. Equal block numbers have no defined order. An empty
    table gives no rows; null texts are blank.
    """
    here = Window.partitionBy(*by).orderBy("block_no")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("text", F.lit(""))
    blank = F.btrim(text, F.lit(" \t\r\n\x0b\x0c")) == ""
    told = blocks.withColumns({
        "text": text,
        "is_caption": (F.col("kind") == "text") & is_unit_caption(text),
        "is_heading": F.col("kind") == "heading",
        "is_table": (F.col("kind") == "table") & ~blank,
        "is_note": (F.col("kind") == "table") & blank,
        "new_group": _ran(F.struct("source_group"), F.lag(F.struct("source_group")).over(here)).cast("int"),
    }).withColumn("is_text", (F.col("kind") == "text") & ~blank & ~F.col("is_caption"))
    told = told.withColumns({
        "stretch": F.sum(F.greatest("new_group", (F.col("is_heading") | (F.col("kind") == "table")).cast("int"))).over(so_far),
        "group_no": F.sum("new_group").over(so_far),
        # headings without a paragraph, a table or a new group between them
        "run": F.sum(F.greatest("new_group", (F.col("is_text") | F.col("is_table")).cast("int"))).over(so_far),
        # captions and the table that takes them have the same count of what clears captions
        "cleared": F.coalesce(F.sum((F.col("is_heading") | F.col("is_text") | F.col("is_table")).cast("int")).over(earlier), F.lit(0)) + F.sum("new_group").over(so_far),
    })
    within = lambda *cols: Window.partitionBy(*by, *cols).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("headings", F.when(F.col("is_heading"), F.array_join(F.collect_list(F.when(F.col("is_heading"), F.col("text"))).over(within("run")), DOT)))
    told = told.withColumn("narrative", F.coalesce(F.last("headings", ignorenulls=True).over(within("group_no")), F.nullif(F.first("source_heading").over(within("group_no")), F.lit(""))))
    span = lambda texts: F.transform(texts, lambda t: F.struct(t.alias("text"), F.col("start_char").alias("start_char"), F.col("end_char").alias("end_char")))
    own = F.coalesce("captions", F.array().cast("array<string>"))
    told = told.withColumn("held", F.when(F.col("is_caption"), span(F.array(F.btrim("text", F.lit(" \t\r\n\x0b\x0c"))))).when(F.col("is_note"), span(own)))
    told = told.withColumn("pending", F.flatten(F.collect_list("held").over(within("cleared"))))
    # tables are units as they are
    of_table = F.array_distinct(F.transform("pending", lambda c: c["text"]))
    heading = F.nullif(F.concat_ws(DOT, "narrative", F.array_join(of_table, DOT)), F.lit(""))
    heading = F.when(F.size(of_table) > 0, heading).otherwise(F.col("narrative"))
    tables = told.where("is_table").select(*by, "block_no", F.lit("table").alias("kind"), F.col("text").alias("body"), heading.alias("heading"), F.concat("pending", span(own)).alias("captions"), "start_char", "end_char", F.lit(1).alias("n_blocks"))
    # paragraphs are packed stretch by stretch
    count = lexical_plan(language)
    head = index_text(context_header(F.col("citation"), F.col("title"), F.col("narrative")), F.lit(""))
    sized = told.where("is_text").withColumns({"tokens": F.size(count(F.col("text"))), "chars": F.length("text"), "head_tokens": F.size(count(head)), "head_chars": F.length(head)})
    packed = sized.groupBy(*by, "stretch").agg(
        F.sort_array(F.collect_list(F.struct("block_no", "text", "start_char", "end_char", "tokens", "chars"))).alias("parts"),
        F.first("head_tokens").alias("head_tokens"), F.first("head_chars").alias("head_chars"), F.first("narrative").alias("heading"),
    )

    @F.pandas_udf("array<int>")
    def begins(head_tokens: pd.Series, head_chars: pd.Series, tokens: pd.Series, chars: pd.Series) -> pd.Series:
        out = []
        for t0, c0, ts, cs in zip(head_tokens, head_chars, tokens, chars, strict=True):
            held_t = held_c = 0
            begun: list[int] = []
            for at, (t, c) in enumerate(zip(ts, cs, strict=True), 1):
                if not begun or t0 + held_t + t > budget.target or c0 + held_c + 2 + c > budget.chars:
                    begun.append(at)
                    held_t, held_c = t, c
                else:
                    held_t, held_c = held_t + t, held_c + 2 + c
            out.append(begun)
        return pd.Series(out)

    dealt = packed.withColumn("begins", begins("head_tokens", "head_chars", F.col("parts.tokens"), F.col("parts.chars")))
    end = lambda k: F.coalesce(F.get("begins", k + 1), F.size("parts") + 1)
    dealt = dealt.select(*by, "heading", F.explode(F.transform("begins", lambda at, k: F.slice("parts", at, end(k) - at))).alias("of"))
    no_captions = F.array().cast("array<struct<text:string,start_char:bigint,end_char:bigint>>")
    texts = dealt.select(*by, F.col("of")[0]["block_no"].alias("block_no"), F.lit("text").alias("kind"), F.array_join(F.col("of.text"), "\n\n").alias("body"), "heading", no_captions.alias("captions"), F.col("of")[0]["start_char"].alias("start_char"), F.element_at("of", -1)["end_char"].alias("end_char"), F.size("of").alias("n_blocks"))
    numbered = F.row_number().over(Window.partitionBy(*by).orderBy("block_no")) - 1
    return texts.unionByName(tables).withColumn("unit_no", numbered).select(*by, "unit_no", "kind", "body", "heading", "captions", "start_char", "end_char", "n_blocks")
