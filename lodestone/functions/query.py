"""Reading questions: web-search syntax, scripts, aliases, scopes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import HANGUL, tokens


def websearch_tokens(query: str) -> list[str]:
    """Tokens that white space outside quotes separates; an open quote runs to the end."""
    return re.findall(r'(?:[^\s"]|"[^"]*"?)+', query)


def positive_text(query: str) -> str:
    """The query without `or` and without exclusions; a lone dash stays."""
    return " ".join(t for t in websearch_tokens(query) if t.lower() != "or" and not (t.startswith("-") and len(t) > 1))


def exclusions(query: str) -> list[str]:
    return [t[1:].strip('"') for t in websearch_tokens(query) if t.startswith("-") and len(t) > 1]


def words(text: str) -> list[str]:
    """The tokens of a text, as `text.tokens` tells them of a column: lower-case runs of letters, marks and digits of any script."""
    return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower()).split()


def _with_phrase(words: list[str], positions: DataFrame) -> DataFrame:
    """(doc_id) of documents that have the words in a row."""
    numbered = positions.sparkSession.createDataFrame(list(enumerate(words)), "nth int, lexeme string")
    hit = positions.join(F.broadcast(numbered), "lexeme").select("doc_id", (F.col("at") - F.col("nth")).alias("begin"), "nth")
    return hit.groupBy("doc_id", "begin").agg(F.count_distinct("nth").alias("n")).where(F.col("n") == len(words)).select("doc_id").distinct()


def relaxed_matches(query: str, positions: DataFrame) -> DataFrame:
    """(doc_id) of documents with any positive operand and no excluded one; all other documents if no operand is positive, and
    none if those that are have no lexeme.

    positions: (doc_id, lexeme, at), lexemes being tokens of any script as `text.tokens` tells them. An operand is a word or a
    quoted phrase; a phrase, and a word that falls into several lexemes, is met where its lexemes stand in a row.
    """
    lexemes = lambda texts: [w for w in map(words, texts) if w]
    operands = websearch_tokens(positive_text(query))
    wanted, unwanted = lexemes(operands), lexemes(exclusions(query))
    if operands and not wanted:
        return positions.select("doc_id").limit(0)

    def having(operands: list[list[str]]) -> DataFrame:
        out = positions.where(F.col("lexeme").isin([w[0] for w in operands if len(w) == 1])).select("doc_id")
        for words in (w for w in operands if len(w) > 1):
            out = out.union(_with_phrase(words, positions))
        return out.distinct()

    out = having(wanted) if wanted else positions.select("doc_id").distinct()
    return out.join(having(unwanted), "doc_id", "left_anti") if unwanted else out


def languages(text: Column) -> Column:
    """All scripts that show: en for ASCII letters, ko for Hangul; en if neither does."""
    found = F.array_compact(F.array(F.when(text.rlike("[A-Za-z]"), F.lit("en")), F.when(text.rlike(HANGUL), F.lit("ko"))))
    return F.when(F.size(found) == 0, F.array(F.lit("en"))).otherwise(found)


def alias_text(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def _alias_texts(values: pd.Series) -> pd.Series:
    return values.map(alias_text, na_action="ignore")


def normalize_alias(value: Column | str) -> Column:
    """NFKC, case folding, single spaces; null stays."""
    return F.pandas_udf(_alias_texts, "string")(value)


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """(alias, owners): normalised aliases that several owners have."""
    named = aliases.select(normalize_alias("alias").alias("alias"), "owner")
    return named.groupBy("alias").agg(F.array_sort(F.collect_set("owner")).alias("owners")).where("size(owners) > 1")


def find_aliases(text: str, aliases: list[str]) -> list[tuple[int, int, str]]:
    """Longest aliases first, none overlapping: (start, end, alias). One of ASCII letters, digits and blanks only must not
    stand inside a run of letters or digits; others, as those with marks, may."""
    alone = lambda a: rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])" if a.isascii() and a.replace(" ", "").isalnum() else re.escape(a)
    spans = {(m.start(), m.end()): a for a in set(aliases) for m in re.finditer(alone(a), text)}
    free, found = [True] * len(text), []
    for start, end in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(free[start:end]):
            free[start:end] = [False] * (end - start)
            found.append((start, end, spans[start, end]))
    return sorted(found)


def alias_matches(questions: DataFrame, aliases: list[str]) -> DataFrame:
    """(query_id, aliases): the aliases that a normalised question names, in its order. The aliases are a checked, small list."""
    if len(aliases) > 100_000:
        raise ValueError("aliases are held by each worker")
    known = [alias_text(a) for a in aliases]

    @F.pandas_udf("array<string>")
    def match(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [a for _, _, a in find_aliases(alias_text(t or ""), known)])

    return questions.select("query_id", match("question").alias("aliases"))


def scope(explicit: Column, alias: Column, default: Column) -> Column:
    """What a question is about: named filters first, then an alias, then the corpus's language."""
    return F.coalesce(explicit, alias, default)


def overlap_terms(question: Column, text: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(tokens(question)), F.array_distinct(tokens(text))))
