"""Queries on statement rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finstrata.functions import exprs as E
from finstrata.operators import statements as S
from finstrata.operators import store
from finstrata.plans.reports import _REPORTS, reports
from finstrata.session import table

CODES = {"long_assets": 1, "current_assets": 37, "total_assets": 65, "equity": 68, "minority": 90, "long_loans": 99, "bonds": 104, "short_loans": 112, "suppliers": 117, "cash": 58, "short_assets": 47}
ALIASES = {"cash": ("novac na racunima i u blagajni", "money at banks and in hand"), "total_assets": ("ukupna imovina", "assets together"), "equity": ("vlastiti kapital", "own capital")}

_FACTS = """fv AS (SELECT * EXCLUDE (k) FROM (
  SELECT *, regexp_replace(lower(column_name), '[^a-z0-9]+', '', 'g') AS col, row_number() OVER (PARTITION BY local_path, statement, adp_code, regexp_replace(lower(column_name), '[^a-z0-9]+', '', 'g') ORDER BY parsed_at DESC NULLS LAST, fact_id DESC) AS k
  FROM facts) WHERE k = 1),
bs AS (SELECT * FROM fv WHERE statement = 'balance_sheet' AND col = 'currentperiod'),
w AS (SELECT local_path, """ + ", ".join(f"max(value) FILTER (adp_code = {c}) AS {n}" for n, c in CODES.items()) + f""" FROM bs WHERE adp_code IN ({", ".join(map(str, CODES.values()))}) GROUP BY local_path)"""


def _values(spark, sf_dir):
    return S.fact_values(table(spark, sf_dir, "facts"))


def _sheet(spark, sf_dir):
    return _values(spark, sf_dir).filter("statement = 'balance_sheet' AND column = 'currentperiod'")


def _wide(spark, sf_dir):
    return S.wide_codes(_values(spark, sf_dir), "balance_sheet", "currentperiod", CODES)


def facts_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


def facts_long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return S.to_long(li, keys, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def label_unique(spark, sf_dir):
    return S.label_lookup(_sheet(spark, sf_dir), ALIASES, {"cash": 58, "total_assets": 65, "equity": 68}, codes_first=("equity",))


def section_lookup(spark, sf_dir):
    c = F.col("adp_code")
    return S.section_lookup(_sheet(spark, sf_dir), c == 37, c == 58, c == 65)


def debt_bridge(spark, sf_dir):
    d = S.debt_bridge(_wide(spark, sf_dir))
    return d.select("local_path", *[F.round(x, 6).alias(x) for x in d.columns[1:]])


def parent_equity(spark, sf_dir):
    w = _wide(spark, sf_dir).join(reports(spark, sf_dir).select("local_path", "consolidated"), "local_path")
    none = F.lit(None).cast("double")
    return w.select("local_path", F.round(S.parent_equity(none, F.col("equity"), F.col("minority"), F.col("consolidated")), 4).alias("equity_parent"), F.when(F.col("minority").isNotNull(), "derived").when(F.col("consolidated") == 0, "total").otherwise("unavailable").alias("quality"))


def cash_method(spark, sf_dir):
    return S.cash_method(_values(spark, sf_dir))


def balance_check(spark, sf_dir):
    w = _wide(spark, sf_dir).join(reports(spark, sf_dir).select("local_path", "consolidated", "period_end"), "local_path")
    ok = {
        "sides differ": ~F.coalesce(S.off_balance(F.col("total_assets"), F.col("long_assets") + F.col("current_assets")), F.lit(False)),
        "no total": F.col("total_assets").isNotNull(), "unconsolidated": F.coalesce(F.col("consolidated") != 0, F.lit(True)), "no period end": F.col("period_end").isNotNull(),
    }
    return store.violations(w, ok, ["local_path"])


def equity_suspect(spark, sf_dir):
    v = _values(spark, sf_dir).filter("statement = 'income_statement' AND column = 'currentcumulative'")
    inc = v.groupBy("local_path").agg(F.max(F.when(F.col("adp_code") == 61, F.col("value"))).alias("income"), F.max(F.when(F.col("adp_code") == 64, F.col("value"))).alias("income_parent"))
    w = _wide(spark, sf_dir).join(inc, "local_path")
    suspect = S.equity_suspect(F.col("equity"), F.col("equity") - F.coalesce("minority", F.lit(0.0)), F.col("income"), F.col("income_parent"))
    return w.select("local_path", suspect.alias("suspect"), F.round(F.when(~suspect, E.ratio(F.col("income_parent"), F.col("equity"))), 6).alias("roe"))


def annualised(spark, sf_dir):
    v = _values(spark, sf_dir).filter("statement = 'income_statement' AND column = 'currentcumulative' AND adp_code = 1").select("local_path", "value")
    j = v.join(reports(spark, sf_dir).select("local_path", "quarter", "period_start", "period_end"), "local_path")
    return j.select("local_path", F.round(F.col("value") * S.annual_factor(F.col("quarter"), F.col("period_start"), F.col("period_end")), 4).alias("run_rate"))


QUERIES = {f.__name__: f for f in (facts_wide, facts_long, label_unique, section_lookup, debt_bridge, parent_equity, cash_method, balance_check, equity_suspect, annualised)}


def _present(*xs: str) -> str:
    return f"CASE WHEN coalesce({', '.join(xs)}) IS NOT NULL THEN {' + '.join(f'coalesce({x}, 0)' for x in xs)} END"


_KEY = "regexp_replace(regexp_replace(trim(regexp_replace(lower(replace(strip_accents(replace(label, 'đ', '#')), '#', 'đ')), '[^a-z0-9]+', ' ', 'g')), '(\\S) (aop|adp)\\b.*$', '\\1'), '^(([ivxlcdm]+|[a-z]|[0-9]+)( |$))+', '')"
_LABEL = ", ".join(
    "coalesce({}) AS {}".format(
        ", ".join(
            (lambda label, code: (code, label) if n == "equity" else (label, code))(
                f"CASE WHEN count(*) FILTER (key IN {ALIASES[n]} AND value IS NOT NULL) = 1 THEN max(value) FILTER (key IN {ALIASES[n]} AND value IS NOT NULL) END", f"max(value) FILTER (adp_code = {CODES[n]})"
            )
        ),
        n,
    )
    for n in ALIASES
)
_GROSS, _LONG, _LIQUID = _present("long_loans", "bonds", "short_loans"), _present("long_loans", "bonds"), _present("cash", "short_assets")

ORACLES = {
    "facts_wide": f"WITH {_FACTS} SELECT local_path, {', '.join(CODES)} FROM w",
    "facts_long": "UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME measure VALUE value",
    "label_unique": f"WITH {_FACTS}, k AS (SELECT *, {_KEY} AS key FROM bs) SELECT local_path, {_LABEL} FROM k GROUP BY local_path",
    "section_lookup": f"""WITH {_FACTS}, h AS (SELECT local_path, max(source_row) AS top FROM bs WHERE adp_code = 37 GROUP BY 1 HAVING count(*) = 1),
      e AS (SELECT h.local_path, min(source_row) AS bottom FROM h LEFT JOIN bs ON bs.local_path = h.local_path AND adp_code = 65 AND source_row > top GROUP BY 1),
      i AS (SELECT h.local_path, count(*) AS items, max(value) AS v FROM h JOIN e USING (local_path) JOIN bs ON bs.local_path = h.local_path AND adp_code = 58 AND value IS NOT NULL AND source_row > top AND (bottom IS NULL OR source_row < bottom) GROUP BY 1)
      SELECT b.local_path, CASE WHEN items = 1 THEN v END AS value, coalesce(items, 0) AS items FROM (SELECT DISTINCT local_path FROM bs) b LEFT JOIN i USING (local_path)""",
    "debt_bridge": f"""WITH {_FACTS}, d AS (SELECT *, {_GROSS} AS g, {_LONG} AS l, {_LIQUID} AS q FROM w)
      SELECT local_path, round(g, 6) AS gross_debt, round(l, 6) AS long_debt, round(q, 6) AS liquid_assets, round(g - cash, 6) AS net_debt_cash, round(g - q, 6) AS net_debt_liquid, round(l / nullif(g, 0), 6) AS long_share, round(suppliers - short_loans, 6) AS suppliers_less_loans FROM d""",
    "parent_equity": f"WITH {_REPORTS}, {_FACTS} SELECT w.local_path, round(coalesce(equity - minority, CASE WHEN minority IS NULL AND consolidated = 0 THEN equity END, CASE WHEN consolidated = 0 THEN equity END), 4) AS equity_parent, CASE WHEN minority IS NOT NULL THEN 'derived' WHEN consolidated = 0 THEN 'total' ELSE 'unavailable' END AS quality FROM w JOIN reports r USING (local_path)",
    "cash_method": f"WITH {_FACTS}, c AS (SELECT local_path, count(*) FILTER (statement = 'cash_flow_direct' AND value <> 0) AS direct, count(*) FILTER (statement = 'cash_flow_indirect' AND value <> 0) AS indirect FROM fv WHERE statement IN ('cash_flow_direct', 'cash_flow_indirect') GROUP BY 1) SELECT *, CASE WHEN direct >= indirect THEN 'direct' ELSE 'indirect' END AS method FROM c",
    "balance_check": f"""WITH {_REPORTS}, {_FACTS}, j AS (SELECT w.*, consolidated, period_end FROM w JOIN reports r USING (local_path))
      SELECT local_path, 'sides differ' AS rule FROM j WHERE abs(total_assets - (long_assets + current_assets)) > greatest(1, abs(total_assets) * 1e-6)
      UNION ALL SELECT local_path, 'no total' FROM j WHERE total_assets IS NULL UNION ALL SELECT local_path, 'unconsolidated' FROM j WHERE consolidated = 0 UNION ALL SELECT local_path, 'no period end' FROM j WHERE period_end IS NULL""",
    "equity_suspect": f"""WITH {_FACTS}, i AS (SELECT local_path, max(value) FILTER (adp_code = 61) AS income, max(value) FILTER (adp_code = 64) AS ip FROM fv WHERE statement = 'income_statement' AND col = 'currentcumulative' GROUP BY 1),
      s AS (SELECT w.local_path, equity, ip, coalesce(abs(equity - (equity - coalesce(minority, 0))) <= greatest(1, abs(equity) * 1e-9) AND abs(income - ip) > 0, false) AS suspect FROM w JOIN i USING (local_path))
      SELECT local_path, suspect, round(CASE WHEN NOT suspect THEN ip / nullif(equity, 0) END, 6) AS roe FROM s""",
    "annualised": f"WITH {_REPORTS}, {_FACTS} SELECT local_path, round(value * coalesce(CASE WHEN quarter BETWEEN 1 AND 4 THEN 4.0 / quarter END, 365.25 / nullif(datediff('day', period_start, period_end) + 1, 0)), 4) AS run_rate FROM fv JOIN reports r USING (local_path) WHERE statement = 'income_statement' AND col = 'currentcumulative' AND adp_code = 1",
}
