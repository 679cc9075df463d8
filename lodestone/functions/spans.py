"""Column functions on half-open spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """How many characters two spans share."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def covered(spans: Column, start: Column, end: Column) -> Column:
    """How much of [start, end) an array of (s, e) covers, places that several cover counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), start.cast("long").alias("at"))

    def step(acc: Column, span: Column) -> Column:
        begin, stop = F.greatest(span["s"].cast("long"), acc["at"]), F.least(span["e"].cast("long"), end.cast("long"))
        return F.struct((acc["sum"] + F.greatest(stop - begin, F.lit(0).cast("long"))).alias("sum"), F.greatest(acc["at"], stop).alias("at"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["sum"])
