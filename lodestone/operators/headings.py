"""Headings of filings: items by number, by canonical title or by a filing's own titles, told from running text by style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a heading names its item, how long it may be, how bold it is, and when numbers are headings at all.
ITEM = r"(?i)^\s*item\s+(1[0-6]|[1-9])([A-C])?\s*[.\-–—:]?\s*.*$"
HEADING_CHARS, BOLD, OUTSIDE, LEAST, CONTENTS_ITEMS, CONTENTS_SHARE = 300, 700, 15, 5, 10, 0.15
#: Shorter titles match by accident; longer ones match by so many first characters.
TITLE_CHARS, PREFIX_CHARS = 8, 14


def font_weight(style: Column, tag: Column, bold_text: Column | None = None) -> Column:
    """A block's weight from its inline style, else 400; a heading's tag, or text that is bold throughout, counts as 700."""
    told = F.regexp_extract(F.coalesce(style, F.lit("")), r"font-weight:\s*(\d+|bold)", 1)
    own = F.when(told == "bold", BOLD).when(told != "", told.cast("int")).otherwise(400)
    marked = tag.rlike("^(b|strong|th|h[1-6])$")
    if bold_text is not None:
        marked = marked | bold_text
    return F.greatest(own, F.when(marked, BOLD).otherwise(400))


def font_size(style: Column) -> Column:
    """A block's size in points from its inline style, 0 if it has none."""
    return F.coalesce(F.regexp_extract(F.coalesce(style, F.lit("")), r"font-size:\s*([\d.]+)pt", 1).try_cast("double"), F.lit(0.0))


def item_number(text: Column) -> Column:
    """The item that a text begins with, such as 7A; null if there is none."""
    code = F.upper(F.concat(F.regexp_extract(text, ITEM, 1), F.regexp_extract(text, ITEM, 2)))
    return F.nullif(code, F.lit(""))


def number_rules(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, font_weight, font_size, in_table): how a document's numbered headings look, for documents that have such.

    blocks: (key, block_no, text, font_weight, font_size, in_table). Bold short blocks that name an item are headings where OUTSIDE
    of them stand outside tables; else those in tables count too, LEAST at least, unless all candidates of the document lie within
    CONTENTS_SHARE of its blocks, as in a table of contents. The rule is the loosest that covers them all.
    """
    named = (F.length(F.coalesce("text", F.lit(""))) <= HEADING_CHARS) & item_number(F.col("text")).isNotNull()
    told = blocks.withColumn("named", F.coalesce(named, F.lit(False))).withColumn("bold", F.col("named") & (F.col("font_weight") >= BOLD))
    place = F.row_number().over(Window.partitionBy(key).orderBy("block_no"))
    outside = F.col("bold") & ~F.col("in_table")
    of = told.withColumn("place", place).groupBy(key).agg(
        F.count_if(outside).alias("n_outside"), F.count_if("bold").alias("n_all"), F.count(F.lit(1)).alias("n"), F.count_if("named").alias("n_named"),
        (F.max(F.when(F.col("named"), F.col("place"))) - F.min(F.when(F.col("named"), F.col("place")))).alias("spread"),
        *(F.min(F.when(c, F.col(p))).alias(f"{p}_{x}") for x, c in (("outside", outside), ("all", F.col("bold"))) for p in ("font_weight", "font_size")),
    )
    free = F.col("n_outside") >= OUTSIDE
    contents = (F.col("n_named") >= CONTENTS_ITEMS) & (F.col("spread") < F.col("n") * CONTENTS_SHARE)
    kept = of.where(free | ((F.col("n_all") >= LEAST) & ~contents))
    return kept.select(key, *(F.when(free, F.col(f"{p}_outside")).otherwise(F.col(f"{p}_all")).alias(p) for p in ("font_weight", "font_size")), (~free).alias("in_table"))


def plain(text: Column) -> Column:
    """A title for comparison: lower-case ASCII letters and blanks only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z ]", ""))


def canonical_items(texts: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item) of the texts (keys, text) that say a canonical title (item, title, place); of several the first by place.

    A text of TITLE_CHARS plain letters or more is a title if it is equal to it, or if one begins with the first PREFIX_CHARS of the
    other and the title is so long. Each title is dealt to its first 8, 9, ... 14 characters, and a text looks up its first 14 or
    itself, so that a prefix match is a join on equality, as with the paths of a trie.
    """
    named = titles.select("item", "place", plain(F.col("title")).alias("c")).where("c <> ''")
    cuts = F.transform(F.sequence(F.lit(TITLE_CHARS), F.lit(PREFIX_CHARS)), lambda n: F.substring("c", F.lit(1), n))
    paths = named.select("item", "place", F.explode(F.array_distinct(F.when(F.length("c") >= PREFIX_CHARS, cuts).otherwise(F.array("c")))).alias("path"))
    first = paths.groupBy("path").agg(F.min_by("item", "place").alias("item"))
    asked = texts.select(*keys, plain(F.col("text")).alias("t")).where(F.length("t") >= TITLE_CHARS).select(*keys, F.substring("t", 1, PREFIX_CHARS).alias("path"))
    return asked.join(first, "path").select(*keys, "item")


def custom_items(texts: DataFrame, titles: DataFrame, keys: list[str], key: str = "doc_id") -> DataFrame:
    """(keys, item) of texts that are one of their own document's titles (key, item, title, place), whatever the letters' case."""
    same = lambda c: F.lower(F.btrim(F.col(c), F.lit(" \t\r\n\x0b\x0c")))
    named = titles.select(key, "item", "place", same("title").alias("t")).groupBy(key, "t").agg(F.min_by("item", "place").alias("item"))
    return texts.select(*keys, same("text").alias("t")).join(named, [key, "t"]).select(*keys, "item")


def headings(blocks: DataFrame, items: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block_no, item) of the blocks that name an item and look as their document's rule says: as bold and as large at least,
    and outside tables unless the rule allows these. Documents without a rule have none."""
    looks = rules.select(key, F.col("font_weight").alias("least_weight"), F.col("font_size").alias("least_size"), F.col("in_table").alias("tables"))
    both = blocks.select(key, "block_no", "font_weight", "font_size", "in_table").join(items, [key, "block_no"]).join(looks, key)
    fits = (F.col("font_weight") >= F.col("least_weight")) & (F.col("font_size") >= F.col("least_size")) & (F.col("tables") | ~F.col("in_table"))
    return both.where(fits).select(key, "block_no", "item")
