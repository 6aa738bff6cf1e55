"""Statement rows: long and wide forms, label and section lookups, derived metrics and checks.

All rules work on all reports at once, as conditional aggregates per report; no rule needs a
row's neighbours, so nothing but the report's key is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.exprs import label_key, ratio, sum_present
from finstrata.functions.text import alnum_key
from finstrata.operators.ranking import best_per_group

CELL = ("local_path", "statement", "adp_code", "column")


def fact_values(facts: DataFrame) -> DataFrame:
    """One row per cell (local_path, statement, adp_code, column): the fact parsed last, then with the highest id.

    Columns' spellings are one column; a null value of the last parse stays null.
    """
    f = facts.withColumn("column", alnum_key(F.col("column_name")))
    return best_per_group(f, CELL, [F.col("parsed_at").desc_nulls_last(), F.col("fact_id").desc()])


def wide_codes(values: DataFrame, statement: str, column: str, codes: dict[str, int]) -> DataFrame:
    """One row per report with the value of each named code; null where the report lacks it."""
    v = values.filter((F.col("statement") == statement) & (F.col("column") == column) & F.col("adp_code").isin(*codes.values()))
    return v.groupBy("local_path").agg(*[F.max(F.when(F.col("adp_code") == c, F.col("value"))).alias(n) for n, c in codes.items()])


def to_long(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys..., measure, value) with a row for every measure of every row, nulls too."""
    return df.unpivot([*map(F.col, keys)], [F.col(m) for m in measures], "measure", "value")


def label_lookup(values: DataFrame, aliases: dict[str, Sequence[str]], codes: dict[str, int] | None = None, codes_first: Sequence[str] = ()) -> DataFrame:
    """One row per report: for each name the value of its only non-null row labelled by an alias, else that of its code.

    Two matching rows are ambiguous and give null, as none does; then the code decides. Names in
    `codes_first` try the code before the label. `values` is one statement and column of fact_values.
    """
    key = label_key(F.col("label"))
    v = values.withColumn("key", key)
    found = []
    for name, words in aliases.items():
        hit = F.col("key").isin(*words) & F.col("value").isNotNull()
        by_label = F.when(F.count_if(hit) == 1, F.max(F.when(hit, F.col("value"))))
        by_code = F.max(F.when(F.col("adp_code") == (codes or {}).get(name, -1), F.col("value")))
        found.append(F.coalesce(*((by_code, by_label) if name in codes_first else (by_label, by_code))).alias(name))
    return v.groupBy("local_path").agg(*found)


def section_lookup(values: DataFrame, header: Column, item: Column, end: Column) -> DataFrame:
    """(local_path, value, items): the only item below a report's only section header and above the next section's.

    Positions are source_row; with no later end the section is open. No or several headers, no or several
    items with a value give null.
    """
    row = F.col("source_row")
    v = values.select("local_path", row.alias("row"), "value", header.alias("is_header"), item.alias("is_item"), end.alias("is_end"))
    heads = v.groupBy("local_path").agg(F.count_if("is_header").alias("n"), F.max(F.when(F.col("is_header"), F.col("row"))).alias("top")).filter("n = 1").select("local_path", "top")
    below = v.join(heads, "local_path").filter("row > top")
    ends = below.groupBy("local_path").agg(F.min(F.when(F.col("is_end"), F.col("row"))).alias("bottom"))
    inside = below.join(ends, "local_path").filter("is_item AND value IS NOT NULL AND (bottom IS NULL OR row < bottom)")
    got = inside.groupBy("local_path").agg(F.count(F.lit(1)).alias("items"), F.max("value").alias("v"))
    every = values.select("local_path").distinct()
    return every.join(got, "local_path", "left").select("local_path", F.when(F.col("items") == 1, F.col("v")).alias("value"), F.coalesce("items", F.lit(0)).alias("items"))


def both_or_none(a: Column, b: Column) -> Column:
    """a + b with a missing one as 0, null only if both are missing."""
    return sum_present(a, b)


def parent_equity(addendum: Column, total: Column, minority: Column, consolidated: Column) -> Column:
    """The stated parent equity, else total less minority, else the total of a report known to be unconsolidated."""
    return F.coalesce(addendum, F.when(minority.isNotNull(), total - minority), F.when(consolidated == 0, total))


def debt_bridge(w: DataFrame) -> DataFrame:
    """From long and short loans, bonds, liabilities, cash and short-term assets: debts gross and net."""
    gross = sum_present(F.col("long_loans"), F.col("bonds"), F.col("short_loans"))
    liquid = both_or_none(F.col("cash"), F.col("short_assets"))
    long_ = sum_present(F.col("long_loans"), F.col("bonds"))
    return w.select(
        "local_path", gross.alias("gross_debt"), long_.alias("long_debt"), liquid.alias("liquid_assets"),
        (gross - F.col("cash")).alias("net_debt_cash"), (gross - liquid).alias("net_debt_liquid"),
        ratio(long_, gross).alias("long_share"), (F.col("suppliers") - F.col("short_loans")).alias("suppliers_less_loans"),
    )


def cash_method(values: DataFrame) -> DataFrame:
    """(local_path, direct, indirect, method): the cash flow statement with more non-zero cells, direct if equal."""
    nonzero = lambda s: F.count_if((F.col("statement") == s) & (F.col("value") != 0))
    c = values.filter(F.col("statement").isin("cash_flow_direct", "cash_flow_indirect")).groupBy("local_path").agg(nonzero("cash_flow_direct").alias("direct"), nonzero("cash_flow_indirect").alias("indirect"))
    return c.withColumn("method", F.when(F.col("direct") >= F.col("indirect"), "direct").otherwise("indirect"))


def off_balance(total: Column, other: Column, share: float = 1e-6) -> Column:
    """Whether two sides differ by more than 1 and more than the share of the total; null if a side is missing."""
    return F.abs(total - other) > F.greatest(F.lit(1.0), F.abs(total) * share)


def equity_suspect(total: Column, parent: Column, income: Column, income_parent: Column) -> Column:
    """Whether all equity is called the parent's though the incomes differ."""
    same = F.abs(total - parent) <= F.greatest(F.lit(1.0), F.abs(total) * 1e-9)
    return F.coalesce(same & (F.abs(income - income_parent) > 0), F.lit(False))


def annual_factor(quarter: Column, start: Column, end: Column) -> Column:
    """4 / quarter, else 365.25 over the days of the period, both ends counted."""
    return F.coalesce(F.when(quarter.between(1, 4), F.lit(4.0) / quarter), ratio(F.lit(365.25), F.datediff(end, start) + 1))
