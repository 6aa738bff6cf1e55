"""Trailing twelve months, growth and trends over yearly and quarterly flows, for all issuers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.functions.exprs import cagr, ratio, to_eur

#: flows: ticker, year, quarter (null: the year), metric, value (cumulative within the year), unit.


def ttm(flows: DataFrame) -> DataFrame:
    """(ticker, metric, year, quarter, value, quality, formula): the last twelve months up to each period.

    A year is its own value; a quarter q of year y is the year y-1 plus the year to date minus the year to date a year
    before. Where the year lacks a value, its fourth quarter stands in (`ttm-q4-fallback`). Any
    missing part makes the value null and the quality `unavailable`; nothing is ever annualised.
    Amounts are converted to EUR first; other units than EUR and HRK are unavailable.
    Flows must be unique in (ticker, metric, year, quarter).
    """
    f = flows.select("ticker", "metric", "year", "quarter", to_eur(F.col("value"), F.col("unit")).alias("v"))
    keys = ["ticker", "metric", "year"]
    year = f.filter("quarter IS NULL").select(*keys, F.col("v").alias("fy"), F.lit(True).alias("listed"))
    q4 = f.filter("quarter = 4").select(*keys, F.col("v").alias("q4"))
    ends = year.join(q4, keys, "full").select(*keys, F.coalesce("fy", "q4").alias("end"), (F.col("fy").isNull() & F.col("q4").isNotNull()).alias("stood_in"))
    before = ends.select("ticker", "metric", (F.col("year") + 1).alias("year"), F.col("end").alias("p_end"), F.col("stood_in").alias("p_in"))
    same = f.filter("quarter < 4").select("ticker", "metric", (F.col("year") + 1).alias("year"), "quarter", F.col("v").alias("p_ytd"))
    quarters = f.filter("quarter < 4").join(before, keys, "left").join(same, [*keys, "quarter"], "left")
    value = F.col("p_end") + F.col("v") - F.col("p_ytd")
    out = quarters.select(
        *keys, "quarter", value.alias("value"),
        F.when(value.isNull(), "unavailable").when(F.col("p_in"), "ttm-q4-fallback").otherwise("ttm").alias("quality"),
        F.lit("FY(y-1) + YTD(y) - YTD(y-1)").alias("formula"),
    )
    whole = ends.select(
        *keys, F.lit(None).cast("int").alias("quarter"), F.col("end").alias("value"),
        F.when(F.col("end").isNull(), "unavailable").when(F.col("stood_in"), "ttm-q4-fallback").otherwise("ttm").alias("quality"), F.lit("FY(y)").alias("formula"),
    )
    return out.unionByName(whole)


def growth(yearly: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """yearly (ticker, year, value) with the compound growth over each horizon; the exact earlier year must be there."""
    out = yearly
    for h in horizons:
        past = yearly.select("ticker", (F.col("year") + h).alias("year"), F.col("value").alias(f"v{h}"))
        out = out.join(past, ["ticker", "year"], "left").withColumn(f"cagr_{h}y", cagr(F.col(f"v{h}"), F.col("value"), h)).drop(f"v{h}")
    return out


def returns_on_average(flow: DataFrame, stock: DataFrame) -> DataFrame:
    """(ticker, year, return): the flow over the mean of the stock at both ends of the year; null without both."""
    past = stock.select("ticker", (F.col("year") + 1).alias("year"), F.col("value").alias("opening"))
    j = flow.withColumnRenamed("value", "flow").join(stock.withColumnRenamed("value", "closing"), ["ticker", "year"], "left").join(past, ["ticker", "year"], "left")
    return j.select("ticker", "year", ratio(F.col("flow"), (F.col("opening") + F.col("closing")) / 2).alias("return"))
