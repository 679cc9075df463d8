"""Ledgers and logs: usage and cost, rate windows, progress, sessions of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(ledger: DataFrame, *by: str) -> DataFrame:
    """Requests, tokens and exact cost of each group, and when it was last used."""
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.max("ts").alias("last"))


def rollup(ledger: DataFrame, outer: str, inner: str) -> DataFrame:
    """(level, outer, inner, requests, cost): models, their providers, and the grand total, in one pass."""
    out = ledger.rollup(outer, inner).agg(F.grouping_id().alias("id"), F.count(F.lit(1)).alias("requests"), F.sum("cost").alias("cost"))
    return out.select(F.element_at(F.create_map(F.lit(0), F.lit("inner"), F.lit(1), F.lit("outer"), F.lit(3), F.lit("all")), F.col("id").cast("int")).alias("level"), outer, inner, "requests", "cost")


def daily(ledger: DataFrame) -> DataFrame:
    """(day, micros, running): each UTC day's cost in millionths, rounded up by request, and the sum so far."""
    days = ledger.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.ceil(F.col("cost") * 1_000_000)).cast("long").alias("micros"))
    return days.withColumn("running", F.sum("micros").over(Window.orderBy("day")))


def token_cost(regular: Column, cached: Column, out: Column, prices: tuple[str, str, str]) -> Column:
    """Exact cost at prices a million tokens."""
    price = lambda p: F.lit(p).cast("decimal(18,6)")
    return (regular * price(prices[0]) + cached * price(prices[1]) + out * price(prices[2])) / F.lit(1_000_000).cast("decimal(18,0)")


def first_exhausted(limits: dict[str, tuple[Column, int]]) -> Column:
    """The first resource in order whose use is over its limit, or null."""
    out = F.lit(None).cast("string")
    for name, (used, limit) in reversed(limits.items()):
        out = F.when(used > limit, F.lit(name)).otherwise(out)
    return out


def rate_windows(log: DataFrame, key: str, at: str, spans: dict[str, int]) -> DataFrame:
    """Adds, for each span of seconds, how many of the key's requests fall into it up to and with this one."""
    for name, seconds in spans.items():
        log = log.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds + 1, 0)))
    return log


def positions(queue: DataFrame, by: list[str]) -> DataFrame:
    """Adds position: each job's place among those that wait."""
    return queue.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)))


def monotone(progress: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds shown: progress that never falls."""
    return progress.withColumn("shown", F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def stage_clock(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, started, ended, seconds) from first to last event of a stage."""
    out = events.groupBy(*by).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return out.withColumn("seconds", (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6)


def last_state(events: DataFrame, key: str) -> DataFrame:
    """(key, state, ts): a job's newest event."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))
