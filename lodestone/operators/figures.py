"""Figures in answers against those in the evidence, with the periods that table columns stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import figures, magnitude, years

#: Verdicts from the best to the worst.
VERDICTS = ["verified", "period_mismatch", "unverified"]


def column_years(cells: DataFrame, headers: DataFrame, captions: DataFrame) -> DataFrame:
    """Adds years to cells (table_id, start_col, end_col, …): those of the headers over the cell's columns; without any, the
    caption's year if it names exactly one.

    headers: (table_id, h_start, h_end, h_text), half-open columns. captions: (table_id, caption).
    """
    h = headers.select("table_id", "h_start", "h_end", years(F.col("h_text")).alias("h_years")).where("size(h_years) > 0")
    keyed = cells.withColumn("cell_no", F.struct("table_id", "row", "start_col"))
    over = keyed.join(h, "table_id").where((F.col("h_start") < F.col("end_col")) & (F.col("start_col") < F.col("h_end")))
    named = over.groupBy("cell_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h_years")))).alias("named"))
    only = captions.select("table_id", years(F.col("caption")).alias("c_years")).where("size(c_years) = 1")
    out = keyed.join(named, "cell_no", "left").join(only, "table_id", "left")
    return out.withColumn("years", F.coalesce("named", "c_years", F.array().cast("array<int>"))).drop("named", "c_years", "cell_no")


def check_figures(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, figure, verdict, found_years): each figure of an answer against the evidence's figures.

    answers: (answer_id, answer, requested: array of years). evidence: (answer_id, value, years), and label, if there is such
    a column: a label is a figure of a header or title. A figure is verified by an equal magnitude of a requested period, or
    of any if none is requested. If all equal ones have periods, but others, it is a mismatch; if some have none, it is
    unverified, as it is where nothing is equal. Labels count only where no other figure is equal; they verify in any case.
    """
    label = F.coalesce(F.col("label"), F.lit(False)) if "label" in evidence.columns else F.lit(False)
    asked = answers.select("answer_id", F.coalesce("requested", F.array().cast("array<int>")).alias("requested"), F.explode(F.array_distinct(figures(F.col("answer")))).alias("figure")).withColumn("m", magnitude(F.col("figure")))
    held = evidence.select("answer_id", magnitude(F.col("value")).alias("m"), F.coalesce("years", F.array().cast(dict(evidence.dtypes)["years"])).alias("years"), label.alias("label")).where("m IS NOT NULL")
    met = asked.join(held, ["answer_id", "m"], "left")
    cell = F.coalesce(~F.col("label"), F.lit(False))
    fits = cell & ((F.size("requested") == 0) | F.arrays_overlap("years", "requested"))
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(cell, F.col("years"))))))
    told = met.groupBy("answer_id", "figure").agg(F.max(fits).alias("ok"), F.max(cell).alias("cells"), F.min(F.when(cell, F.size("years") > 0)).alias("dated"), F.max(F.coalesce("label", F.lit(False))).alias("labelled"), years.alias("found_years"))
    verdict = F.when(F.coalesce("ok", F.lit(False)), "verified").when(F.col("cells") & F.col("dated"), "period_mismatch").when(~F.col("cells") & F.col("labelled"), "verified").otherwise("unverified")
    return told.select("answer_id", "figure", verdict.alias("verdict"), "found_years")


def answer_verdicts(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, verdict): the worst verdict of an answer's figures; an answer without figures is verified."""
    order = F.array(*map(F.lit, VERDICTS))
    worst = check_figures(answers, evidence).groupBy("answer_id").agg(F.max(F.array_position(order, F.col("verdict"))).alias("worst"))
    return answers.select("answer_id").join(worst, "answer_id", "left").select("answer_id", F.element_at(order, F.coalesce("worst", F.lit(1)).cast("int")).alias("verdict"))
