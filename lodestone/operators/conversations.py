"""Conversations: what a follow-up question carries on from the turns before it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A year in a question, and one that a later year replaces, with the Korean word for year.
YEAR, YEAR_NAME = r"(?:19|20)\d{2}", r"(?:19|20)\d{2}년?"


def alias_pattern(aliases: list[str]) -> str:
    """A pattern of all aliases in any case, longer ones first; one of ASCII letters, digits and blanks only stands by itself."""
    if not aliases:
        return r"(?!)"
    one = lambda a: re.escape(a).replace("\\ ", r"\s+")
    alone = lambda a: rf"(?<![0-9A-Za-z]){one(a)}(?![0-9A-Za-z])" if re.fullmatch(r"[0-9A-Za-z\s]+", a) else one(a)
    return "(?iu)(?:" + "|".join(alone(a) for a in sorted(set(aliases), key=lambda a: (-len(a), a))) + ")"


def follow_ups(turns: DataFrame, aliases: list[str], opens: Callable[[Column], Column], follows: Callable[[Column], Column]) -> DataFrame:
    """(conv_id, turn, query): each user turn as it is to be searched.

    A conversation falls into stretches: each turn that doesn't follow begins one, and only those that a topic opens are
    carried on. A following turn in such a stretch is searched as all the stretch up to it, joined by dashes. What a later
    turn of the stretch replaces is left out of the earlier ones: names if it names an alias, years if it has one. The last
    turn up to here that does either tells which parts that concerns, so windows are enough. Parts are trimmed. Null texts are
    empty and neither open nor follow; turns of equal number are ordered by text; other roles' turns are left out.

    opens, follows: conditions on a turn's text. aliases: as they may be written, full-width forms excepted.
    """
    named = alias_pattern(aliases)
    user = turns.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    told = user.withColumn("at", F.row_number().over(order)).withColumn("follows", F.coalesce(follows(F.col("text")), F.lit(False)) & ~F.coalesce(opens(F.col("text")), F.lit(False)))
    told = told.withColumn("stretch", F.sum((~F.col("follows")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy("conv_id", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda pattern: F.coalesce(F.max(F.when(F.regexp_like("text", F.lit(pattern)), F.col("at"))).over(so_far), F.lit(0))
    told = told.withColumn("live", F.coalesce(F.first(opens(F.col("text"))).over(so_far), F.lit(False)) & F.col("follows"))
    told = told.withColumn("named", last(named)).withColumn("dated", last(YEAR)).withColumn("parts", F.collect_list(F.struct("at", "text")).over(so_far))

    def part(p: Column) -> Column:
        unnamed = F.when(p["at"] < F.col("named"), F.regexp_replace(p["text"], F.lit(named), F.lit(" "))).otherwise(p["text"])
        return F.trim(F.when(p["at"] < F.col("dated"), F.regexp_replace(unnamed, F.lit(YEAR_NAME), F.lit(""))).otherwise(unnamed))

    return told.select("conv_id", "turn", F.when(F.col("live"), F.array_join(F.transform("parts", part), " — ")).otherwise(F.col("text")).alias("query"))
