"""Yearly series: growth, direction, and profiles of markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import cagr, pct_change, ratio


def series_growth(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df (keys..., year, value) with yoy, the change in percent on the year before if that year is there.

    Keys are the whole identity of a series (currency, unit, scope and basis too); two rows of a year must be made one before.
    """
    past = df.select(*keys, (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    return df.join(past, [*keys, "year"], "left").select(*keys, "year", "value", pct_change(F.col("value"), F.col("before")).alias("yoy"))


def series_direction(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., points, direction, change, cagr): INCREASING, DECREASING, STABLE, MIXED or INSUFFICIENT below two points.

    change is first to latest in percent; cagr in percent over the years between them, the end may be 0.
    """
    w = Window.partitionBy(*keys).orderBy("year")
    d = df.withColumn("step", F.col("value") - F.lag("value").over(w))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.bool_and(F.col("step") > 0).alias("up"), F.bool_and(F.col("step") < 0).alias("down"), F.bool_and(F.col("step") == 0).alias("flat"),
        F.min_by("value", "year").alias("first"), F.max_by("value", "year").alias("last"), (F.max("year") - F.min("year")).alias("years"),
    )
    direction = F.when(F.col("points") < 2, "INSUFFICIENT").when(F.col("up"), "INCREASING").when(F.col("down"), "DECREASING").when(F.col("flat"), "STABLE").otherwise("MIXED")
    return g.select(*keys, "points", direction.alias("direction"), pct_change(F.col("last"), F.col("first")).alias("change"), F.bround(cagr(F.col("first"), F.col("last"), F.col("years"), allow_zero_end=True) * 100, 4).alias("cagr"))


def market_profile(evidence: DataFrame, core_share: float = 50.0) -> DataFrame:
    """(market, kinds, periods, share, core, status) from evidence (market, kind, period, amount).

    status: DIRECT with a contract, REPEATED with revenue in two periods or more, else REPORTED; core: the market's share
    of all amounts is at least core_share percent.
    """
    g = evidence.groupBy("market").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("period")).alias("periods"), F.count_distinct(F.when(F.col("kind") == "revenue", F.col("period"))).alias("revenue_periods"),
        F.max(F.col("kind") == "contract").alias("contract"), F.sum("amount").alias("amount"),
    )
    total = evidence.agg(F.sum("amount")).first()[0]
    share = ratio(F.col("amount"), F.lit(total)) * 100
    status = F.when(F.col("contract"), "DIRECT").when(F.col("revenue_periods") >= 2, "REPEATED").otherwise("REPORTED")
    return g.select("market", "kinds", "periods", F.round(share, 4).alias("share"), (share >= core_share).alias("core"), status.alias("status"))
