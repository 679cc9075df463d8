"""Chunks: sentences packed into budgets of tokens and characters, their spans, headers and keys."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import index_text, korean_tokens, tokens

#: What one input to the index may hold.
TARGET_TOKENS, MAX_TOKENS, MAX_CHARS = 2_048, 8_192, 12_000
#: Fixed value: places between sentences, and between blank lines.
BETWEEN = r"(?<=[.!?。！？])(?=\s)|(?<=\n)(?=\n)"
#: How each language's texts and questions become tokens.
PLANS: dict[str, Callable[[Column], Column]] = {"en": tokens, "ko": korean_tokens}


def lexical_plan(language: str) -> Callable[[Column], Column]:
    """A language's tokens, for index and questions alike; a language without a plan is an error, never a guess."""
    if language not in PLANS:
        raise ValueError(f"no lexical plan for {language!r}; there are {sorted(PLANS)}")
    return PLANS[language]


@dataclass(frozen=True)
class Budget:
    """What a chunk with its header may hold; sentences are added up to the target."""

    target: int = TARGET_TOKENS
    most: int = MAX_TOKENS
    chars: int = MAX_CHARS

    def __post_init__(self) -> None:
        if not 0 < self.target <= self.most or self.chars <= 0:
            raise ValueError(f"{self}")

    def accepts(self, text: Column, language: str = "en") -> Column:
        """Whether a text may be indexed: it has something, and neither too many tokens nor characters."""
        return F.coalesce((F.length(text) > 0) & (F.length(text) <= self.chars) & (F.size(lexical_plan(language)(text)) <= self.most), F.lit(False))


def pieces(sections: DataFrame, budget: Budget = Budget(), language: str = "en") -> DataFrame:
    """(doc_id, section, piece, body): each section's whole sentences in order, in pieces that fit the budget with the header.

    sections: (doc_id, section, header, text). A text that fits stays whole. A sentence beyond the target but within the
    bounds is a piece of its own; one beyond the bounds raises an error when it is read, for nothing is cut. The pieces of a
    section, joined, are its text. Tokens and characters of sentences add up, so only their counts go through the loop, and
    nothing is shuffled. An empty or null text gives no piece.
    """
    count = lexical_plan(language)
    parts = sections.where(F.coalesce("text", F.lit("")) != "").select("doc_id", "section", "header", F.filter(F.split("text", BETWEEN), lambda s: s != "").alias("parts"))
    head = index_text(F.col("header"), F.lit(""))
    sized = parts.select("doc_id", "section", "parts", F.size(count(head)).alias("head_tokens"), F.length(head).alias("head_chars"), F.transform("parts", lambda s: F.size(count(s))).alias("tokens"), F.transform("parts", lambda s: F.length(s)).alias("chars"))

    @F.pandas_udf("array<int>")
    def begins(head_tokens: pd.Series, head_chars: pd.Series, tokens: pd.Series, chars: pd.Series) -> pd.Series:
        out = []
        for t0, c0, ts, cs in zip(head_tokens, head_chars, tokens, chars, strict=True):
            held_t, held_c, told = t0, c0, []
            for at, (t, c) in enumerate(zip(ts, cs, strict=True), 1):
                if t0 + t > budget.most or c0 + c > budget.chars:
                    raise ValueError(f"a sentence of {t} tokens and {c} characters fits nowhere")
                if not told or held_t + t > budget.target or held_c + c > budget.chars:
                    told.append(at)
                    held_t, held_c = t0, c0
                held_t, held_c = held_t + t, held_c + c
            out.append(told)
        return pd.Series(out)

    dealt = sized.withColumn("begins", begins("head_tokens", "head_chars", "tokens", "chars"))
    end = lambda k: F.coalesce(F.get("begins", k + 1), F.size("parts") + 1)
    bodies = F.transform("begins", lambda at, k: F.array_join(F.slice("parts", at, end(k) - at), ""))
    return dealt.select("doc_id", "section", F.posexplode(bodies).alias("piece", "body"))


def enclosing(blocks: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, start_char, end_char) of each group of blocks (start_char, end_char, source_group); gaps between blocks are allowed.

    A block without a span or with an empty one, one that begins before its predecessor's end, and blocks of several source
    groups raise an error when the group is read.
    """
    before = F.lag("end_char").over(Window.partitionBy(*by).orderBy(order))
    bad = ~F.coalesce((F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("start_char") >= F.coalesce(before, F.lit(0))), F.lit(False))
    told = blocks.withColumn("bad", bad).groupBy(*by).agg(F.bool_or("bad").alias("bad"), F.count_distinct("source_group").alias("groups"), F.min("start_char").alias("s"), F.max("end_char").alias("e"))
    wrong = F.when(F.col("bad"), F.raise_error(F.lit("blocks out of order, overlapping or without spans")).cast("bigint")).when(F.col("groups") > 1, F.raise_error(F.lit("blocks of several source groups")).cast("bigint"))
    return told.select(*by, F.coalesce(wrong, F.col("s")).alias("start_char"), F.col("e").alias("end_char"))


def citation(issuer: Column, year: Column, label: Column) -> Column:
    """Where a chunk comes from: issuer, fiscal year and section."""
    return F.concat(issuer, F.lit(" FY"), year.cast("string"), F.lit(" · "), F.coalesce(F.nullif(label, F.lit("")), F.lit("Unnumbered section")))


def context_header(cited: Column, title: Column, heading: Column) -> Column:
    """The citation, the title unless the citation ends in it, and the heading unless it is the title."""
    title, heading = F.nullif(title, F.lit("")), F.nullif(heading, F.lit(""))
    return F.concat_ws(" · ", cited, F.when(~F.endswith(cited, title), title), F.when(~heading.eqNullSafe(title), heading))


def stable_key(numbers: list[str], texts: list[str]) -> Column:
    """The SHA-256 of the columns, whole numbers before texts, as a compact JSON array: the same for the same evidence,
    wherever it stands in a list. Nulls are null."""

    @F.pandas_udf("string")
    def quoted(text: pd.Series) -> pd.Series:
        return text.map(lambda t: "null" if t is None else json.dumps(t, ensure_ascii=False))

    items = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in numbers] + [quoted(F.col(c)) for c in texts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")).cast("binary"), 256)
