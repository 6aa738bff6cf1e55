"""The catalogue of metrics derived from statement rows, for all reports in one pass.

One conditional aggregate per report gathers the coded rows (labels first where a label decides), the
metrics are expressions over that row, and the catalogue is unfolded to (report, metric, value, unit, quality).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.exprs import ratio, sum_present
from finstrata.operators.statements import annual_factor, both_or_none

# Codes of the rows used, by statement and column.
CURRENT = {
    "current_assets": 37, "stfa": 53, "cash": 63, "total_assets": 65, "equity_total": 67, "share_capital": 68, "equity_nci": 89, "long_term_liabilities": 97,
    "lt_group": 99, "lt_participating": 101, "lt_loans": 102, "lt_banks": 103, "lt_securities": 106, "current_liabilities": 109, "st_group": 111, "st_participating": 113, "st_loans": 114, "st_banks": 115, "st_securities": 118,
}
PREVIOUS = {"equity_total_before": 67, "equity_nci_before": 89}
FLOWS = {
    "operating_revenue": 1, "sales_group": 2, "sales_other": 3, "operating_expense": 7, "depreciation": 17, "value_adjustments": 19, "provisions": 22, "financial_income": 30, "financial_expense": 41,
    "interest_group": 42, "interest_other": 44, "total_revenue": 53, "ebt": 55, "net_income_total": 75, "net_income_parent": 76, "comprehensive_income_parent": 100,
}
CASH = {"direct": {"cfo": 14, "capex": 22}, "indirect": {"cfo": 20, "capex": 28}}


def _gather(values: DataFrame) -> DataFrame:
    def pick(statement: str, column: str, code: int) -> Column:
        return F.max(F.when((F.col("statement") == statement) & (F.col("column") == column) & (F.col("adp_code") == code), F.col("value")))

    cols = [pick("balance_sheet", "currentperiod", c).alias(n) for n, c in CURRENT.items()]
    cols += [pick("balance_sheet", "previousperiod", c).alias(n) for n, c in PREVIOUS.items()]
    cols += [pick("income_statement", "currentcumulative", c).alias(n) for n, c in FLOWS.items()]
    for m, codes in CASH.items():
        cols += [pick(f"cash_flow_{m}", "currentperiod", c).alias(f"{m}_{n}") for n, c in codes.items()]
        cols.append(F.count_if((F.col("statement") == f"cash_flow_{m}") & (F.col("value") != 0)).alias(f"{m}_cells"))
    return values.groupBy("local_path").agg(*cols)


def _parent(total: str, nci: str, consolidated: Column) -> Column:
    return F.coalesce(F.col(total) - F.col(nci), F.when(consolidated == 0, F.col(total)))


def metrics(values: DataFrame, headers: DataFrame) -> DataFrame:
    """(local_path, metric, value, unit, quality) for each report: the rows of `fact_values` and its header.

    quality is `reported` for a row's value, `derived` for a formula's, `unavailable` for null. Missing parts count
    as 0 only in sums of debts, sales and interest, in liquid assets, in depreciation and in the value adjustments.
    """
    w = _gather(values).join(headers.select(F.col("path").alias("local_path"), "quarter", "period_start", "period_end", "consolidated"), "local_path", "left")
    c = F.col
    w = w.withColumns({
        "equity_parent": _parent("equity_total", "equity_nci", c("consolidated")), "equity_parent_before": _parent("equity_total_before", "equity_nci_before", c("consolidated")),
        "long_debt": sum_present(c("lt_group"), c("lt_participating"), c("lt_loans"), c("lt_banks"), c("lt_securities")), "short_debt": sum_present(c("st_group"), c("st_participating"), c("st_loans"), c("st_banks"), c("st_securities")),
        "liquid": both_or_none(c("cash"), c("stfa")), "sales": sum_present(c("sales_group"), c("sales_other")), "interest": sum_present(c("interest_group"), c("interest_other")),
        "ebit": c("operating_revenue") - c("operating_expense"), "use_direct": c("direct_cells") >= c("indirect_cells"), "factor": annual_factor(c("quarter"), c("period_start"), c("period_end")),
        "md_ebit": c("ebt") + c("financial_expense") - c("financial_income"), "md_add": both_or_none(c("value_adjustments"), c("provisions")),
    })
    w = w.withColumns({
        "gross_debt": sum_present(c("long_debt"), c("short_debt")), "ebitda": c("ebit") + F.coalesce("depreciation", F.lit(0.0)), "cfo": F.when(c("use_direct"), c("direct_cfo")).otherwise(c("indirect_cfo")),
        "capex": F.abs(F.when(c("use_direct"), c("direct_capex")).otherwise(c("indirect_capex"))), "short_leg": F.coalesce(c("st_banks") + c("st_securities"), c("current_liabilities")),
    })
    eur, rat = "EUR", "ratio"
    reported = [
        ("cash", "cash"), ("short_term_financial_assets", "stfa"), ("current_assets", "current_assets"), ("current_liabilities", "current_liabilities"), ("long_term_liabilities", "long_term_liabilities"), ("total_assets", "total_assets"),
        ("equity_total", "equity_total"), ("equity_nci", "equity_nci"), ("share_capital", "share_capital"), ("operating_revenue_ytd", "operating_revenue"), ("total_revenue_ytd", "total_revenue"), ("depreciation_ytd", "depreciation"),
        ("value_adjustments_ytd", "value_adjustments"), ("provisions_ytd", "provisions"), ("financial_income_ytd", "financial_income"), ("financial_expense_ytd", "financial_expense"), ("ebt_ytd", "ebt"), ("net_income_parent_ytd", "net_income_parent"),
        ("net_income_total_ytd", "net_income_total"), ("comprehensive_income_parent_ytd", "comprehensive_income_parent"), ("operating_cash_flow_ytd", "cfo"),
        *((f"debt_{a}_{long}", f"{a}_{b}") for a in ("lt", "st") for long, b in (("group_loans", "group"), ("participating_loans", "participating"), ("loans_deposits", "loans"), ("banks_financial_institutions", "banks"), ("securities", "securities"))),
    ]
    derived = [
        ("liquid_financial_assets", c("liquid"), eur), ("total_debt_md", both_or_none(c("current_liabilities"), c("long_term_liabilities")), eur), ("total_liabilities", c("current_liabilities") + c("long_term_liabilities"), eur),
        ("equity_parent", c("equity_parent"), eur), ("retained_earnings_reserves_parent", c("equity_parent") - c("share_capital"), eur), ("sales_revenue_ytd", c("sales"), eur), ("interest_expense_ytd", c("interest"), eur),
        ("explicit_long_term_financing_debt", c("long_debt"), eur), ("explicit_short_term_financing_debt", c("short_debt"), eur), ("gross_financial_debt_ex_other", c("gross_debt"), eur), ("gross_financial_debt_standardized", c("gross_debt"), eur),
        ("explicit_external_financing_debt", sum_present(c("lt_loans"), c("lt_banks"), c("lt_securities"), c("st_loans"), c("st_banks"), c("st_securities")), eur), ("explicit_related_party_debt", sum_present(c("lt_group"), c("lt_participating"), c("st_group"), c("st_participating")), eur),
        ("unclassified_long_term_liabilities_residual", c("long_term_liabilities") - c("long_debt"), eur), ("unclassified_current_liabilities_residual", c("current_liabilities") - c("short_debt"), eur),
        ("md_short_term_financial_debt", c("short_leg"), eur), ("md_financial_debt", c("long_term_liabilities") + c("short_leg"), eur), ("md_net_debt", c("long_term_liabilities") + c("short_leg") - c("liquid"), eur),
        ("net_debt_ex_other", c("gross_debt") - c("cash"), eur), ("net_debt_liquid_assets", c("gross_debt") - c("liquid"), eur), ("ebit_ytd", c("ebit"), eur), ("ebitda_simple_ytd", c("ebitda"), eur), ("md_ebit_ytd", c("md_ebit"), eur),
        ("md_value_adjustments_provisions_ytd", c("md_add"), eur), ("md_ebitda_ytd", c("md_ebit") + F.coalesce("depreciation", F.lit(0.0)) + F.coalesce("md_add", F.lit(0.0)), eur), ("capex_ytd", c("capex"), eur), ("free_cash_flow_ytd", c("cfo") - c("capex"), eur),
        ("net_debt_to_ebitda_run_rate", ratio(c("gross_debt") - c("cash"), c("ebitda") * c("factor")), rat), ("roe_run_rate", ratio(c("net_income_parent") * c("factor"), (c("equity_parent") + c("equity_parent_before")) / 2), rat),
        ("interest_coverage_ebit", ratio(c("ebit"), c("interest")), rat), ("debt_to_equity_parent", ratio(c("gross_debt"), c("equity_parent")), rat), ("total_debt_to_equity_parent_md", ratio(both_or_none(c("current_liabilities"), c("long_term_liabilities")), c("equity_parent")), rat),
        ("current_ratio", ratio(c("current_assets"), c("current_liabilities")), rat), ("fcf_margin_ytd", ratio(c("cfo") - c("capex"), c("sales")), rat),
    ]
    rows = [F.struct(F.lit(n).alias("metric"), c(x).cast("double").alias("value"), F.lit(eur).alias("unit"), F.lit("reported").alias("quality")) for n, x in reported]
    rows += [F.struct(F.lit(n).alias("metric"), x.cast("double").alias("value"), F.lit(u).alias("unit"), F.lit("derived").alias("quality")) for n, x, u in derived]
    out = w.select("local_path", F.inline(F.array(*rows)))
    return out.withColumn("quality", F.when(F.col("value").isNull(), "unavailable").otherwise(F.col("quality")))
