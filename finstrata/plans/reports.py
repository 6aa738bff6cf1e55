"""Queries on reports, metrics, securities and flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions import exprs as E
from finstrata.functions.text import alnum_key
from finstrata.operators import periods, ranking
from finstrata.session import table

# --- inputs -------------------------------------------------------------------------------


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.one_row_per_report(table(spark, sf_dir, "parsed_reports"))


_REPORTS = """reports AS (
  SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY local_path ORDER BY parsed_at DESC NULLS LAST, source_id DESC NULLS LAST) rk FROM parsed_reports) WHERE rk = 1),
keyed AS (
  SELECT *, coalesce(issuer_code, '') AS issuer,
    coalesce(CAST(period_end AS VARCHAR), CASE WHEN quarter BETWEEN 1 AND 4 THEN printf('%04d-Q%d', year, quarter) END, printf('%04d-FY', year), local_path) AS period_key,
    CASE WHEN year IS NOT NULL AND quarter BETWEEN 1 AND 4 THEN printf('%04d-Q%d', year, quarter) WHEN year IS NOT NULL THEN printf('%04d-FY', year) ELSE coalesce(CAST(period_end AS VARCHAR), 'unknown-period') END AS period_label,
    CASE consolidated WHEN 1 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS scope_rank, CASE WHEN audited = 1 THEN 0 ELSE 1 END AS audit_rank
  FROM reports),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY issuer, period_key ORDER BY scope_rank DESC, source_publish_date DESC NULLS LAST, audit_rank, parsed_at DESC NULLS LAST, local_path DESC) AS rk,
    count(*) OVER (PARTITION BY issuer, period_key) AS period_candidates
  FROM keyed)"""


def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(local_path, metric, value, unit, quality): each report's metrics under one spelling, as computed last."""
    m = table(spark, sf_dir, "metrics").withColumn("metric", alnum_key(F.col("metric_name")))
    return ranking.best_per_group(m, ["local_path", "metric"], [F.col("parsed_at").desc_nulls_last(), F.col("value").desc_nulls_last(), F.col("quality").desc_nulls_last()]).select("local_path", "metric", "value", "unit", "quality")


_METRICS = """metric_values AS (
  SELECT local_path, metric, value, unit, quality FROM (
    SELECT *, row_number() OVER (PARTITION BY local_path, metric ORDER BY parsed_at DESC NULLS LAST, value DESC NULLS LAST, quality DESC NULLS LAST) rk
    FROM (SELECT *, regexp_replace(lower(metric_name), '[^a-z0-9]+', '', 'g') AS metric FROM metrics)) WHERE rk = 1)"""


def quarter_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, year, quarter, amount): exact order totals by customer nation."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("ticker"))
    return o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("ticker", "year", "quarter").agg(F.sum("amount").alias("amount"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative flows as reports state them: in HRK up to 1998; even years lack the annual value."""
    q = quarter_flows(spark, sf_dir)
    ytd = q.alias("a").join(q.select("ticker", "year", F.col("quarter").alias("q"), F.col("amount").alias("part")), ["ticker", "year"]).filter("q <= quarter").groupBy("ticker", "year", "quarter").agg(F.sum("part").cast("double").alias("v"))
    annual = ytd.filter("quarter = 4").select("ticker", "year", F.lit(None).cast("int").alias("quarter"), F.when(F.col("year") % 2 == 1, F.col("v")).alias("v"))
    unit = F.when(F.col("year") <= 1998, "HRK").otherwise("EUR")
    return ytd.unionByName(annual).select("ticker", "year", "quarter", F.lit("sales").alias("metric"), F.when(unit == "HRK", F.col("v") * F.lit(E.HRK_PER_EUR)).otherwise(F.col("v")).alias("value"), unit.alias("unit"))


_FLOWS = """qf AS (
  SELECT n_name AS ticker, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
ytd AS (SELECT a.ticker, a.year, a.quarter, CAST(sum(b.amount) AS DOUBLE) AS v FROM qf a JOIN qf b ON a.ticker = b.ticker AND a.year = b.year AND b.quarter <= a.quarter GROUP BY ALL),
stated AS (SELECT * FROM ytd UNION ALL SELECT ticker, year, NULL, CASE WHEN year % 2 = 1 THEN v END FROM ytd WHERE quarter = 4),
eur AS (SELECT ticker, year, quarter, CASE WHEN year <= 1998 THEN (v * CAST(7.5345 AS DOUBLE)) / CAST(7.5345 AS DOUBLE) ELSE v END AS v FROM stated)"""

# --- reports ------------------------------------------------------------------------------


def preferred_report(spark, sf_dir):
    return ranking.preferred_reports(reports(spark, sf_dir)).select("issuer", "period_key", "period_label", "local_path", "period_candidates", E.scope_label(F.col("consolidated")).alias("scope"), E.audit_label(F.col("audited")).alias("audit"))


_SCOPE = "CASE consolidated WHEN 1 THEN 'consolidated' WHEN 0 THEN 'unconsolidated' ELSE 'unknown' END AS scope, CASE audited WHEN 1 THEN 'audited' WHEN 0 THEN 'unaudited' ELSE 'unknown' END AS audit"


def candidate_reports(spark, sf_dir):
    return ranking.candidate_reports(reports(spark, sf_dir)).select("issuer", "period_key", "local_path")


def coverage(spark, sf_dir):
    return ranking.coverage(reports(spark, sf_dir))


def latest_metric(spark, sf_dir):
    return ranking.latest_metrics(metric_values(spark, sf_dir), ranking.preferred_reports(reports(spark, sf_dir))).select("issuer", "metric", "value", "unit", "local_path")


def report_sources(spark, sf_dir):
    """Duplicate provenance: documents that several reports claim."""
    r = reports(spark, sf_dir)
    return r.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("local_path")), ",").alias("paths")).filter("n > 1")


def field_availability(spark, sf_dir):
    """How many of the known metrics each preferred report has a value of."""
    p = ranking.preferred_reports(reports(spark, sf_dir)).select("issuer", "period_key", "local_path")
    m = metric_values(spark, sf_dir)
    total = m.agg(F.countDistinct("metric").alias("known"))
    have = m.filter("value IS NOT NULL").groupBy("local_path").agg(F.count(F.lit(1)).alias("available"))
    known = total.first()[0]
    return p.join(have, "local_path", "left").select("issuer", "period_key", F.coalesce("available", F.lit(0)).alias("available"), F.lit(known).cast("bigint").alias("known"))


def report_periods(spark, sf_dir):
    r = ranking.with_period(reports(spark, sf_dir))
    return r.select("local_path", "period_key", "period_label", F.datediff("period_end", "period_start").alias("days"), E.file_kind(F.col("local_path")).alias("kind"))


def yearly_ratio(spark, sf_dir):
    """Return on average equity and margins of the annual preferred reports; the exact year before must be there."""
    p = ranking.preferred_reports(reports(spark, sf_dir)).filter("quarter IS NULL AND year IS NOT NULL").select("issuer", "year", "local_path", "source_publish_date")
    p = ranking.best_per_group(p, ["issuer", "year"], [F.col("source_publish_date").desc_nulls_last(), F.col("local_path").desc()])
    m = metric_values(spark, sf_dir).groupBy("local_path").agg(*[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k) for k in ("netincomeparentytd", "equityparent", "ebitytd", "salesrevenueytd")])
    w = p.join(m, "local_path", "left").withColumnRenamed("issuer", "ticker")
    back = periods.returns_on_average(w.select("ticker", "year", F.col("netincomeparentytd").alias("value")), w.select("ticker", "year", F.col("equityparent").alias("value")))
    return w.join(back, ["ticker", "year"]).select("ticker", "year", F.round("return", 6).alias("roe"), F.round(E.ratio(F.col("ebitytd"), F.col("salesrevenueytd")), 6).alias("ebit_margin"))


# --- flows --------------------------------------------------------------------------------


def ttm(spark, sf_dir):
    t = periods.ttm(flows(spark, sf_dir))
    return t.select("ticker", "metric", "year", "quarter", F.round("value", 2).alias("value"), "quality", "formula")


def _yearly(spark, sf_dir):
    return periods.ttm(flows(spark, sf_dir)).filter("quarter IS NULL").select("ticker", "year", "value")


def growth(spark, sf_dir):
    g = periods.growth(_yearly(spark, sf_dir))
    return g.select("ticker", "year", F.round("value", 2).alias("value"), *[F.round(c, 6).alias(c) for c in ("cagr_1y", "cagr_3y", "cagr_5y")])


def annual_trends(spark, sf_dir):
    """The last five years of each ticker with the change on the year before."""
    y = _yearly(spark, sf_dir)
    past = y.select("ticker", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    j = y.join(past, ["ticker", "year"], "left").select("ticker", "year", F.round("value", 2).alias("value"), F.round(E.ratio(F.col("value") - F.col("before"), F.abs("before")) * 100, 4).alias("yoy"))
    return ranking.best_per_group(j, ["ticker"], [F.col("year").desc()], 5)


def period_compare(spark, sf_dir):
    """Each ticker's years side by side."""
    y = _yearly(spark, sf_dir)
    return y.groupBy("ticker").pivot("year", [1996, 1997, 1998, 1999, 2000]).agg(F.round(F.first("value"), 2)).select("ticker", *[F.col(str(k)).alias(f"y{k}") for k in range(1996, 2001)])


def period_years(spark, sf_dir):
    """Each ticker's values of all its years, by year."""
    y = _yearly(spark, sf_dir).select("ticker", F.struct("year", F.round("value", 2).alias("value")).alias("e"))
    return y.groupBy("ticker").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("years"))


# --- securities and events ----------------------------------------------------------------


def latest_snapshot(spark, sf_dir):
    s = table(spark, sf_dir, "securities").withColumn("key", F.upper(F.trim("ticker")))
    return ranking.best_per_group(s, ["key"], [F.col("updated_at").desc_nulls_last(), F.col("ingested_at").desc_nulls_last(), F.col("snapshot_id").desc()]).select("key", "snapshot_id", "listed_quantity", "updated_at")


def snapshot_history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ranking.best_per_group(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5, "n").select("user_id", "n", "event_id", "ts")


def asof_profile(spark, sf_dir):
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return ranking.as_of(table(spark, sf_dir, "events"), ["user_id"], "ts", cut, ["event_id"]).select("user_id", "event_id", "ts", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        preferred_report, candidate_reports, coverage, latest_metric, report_sources, field_availability, report_periods, yearly_ratio,
        ttm, growth, annual_trends, period_compare, period_years, latest_snapshot, snapshot_history, asof_profile,
    )
}

_TTM = """ends AS (
  SELECT coalesce(f.ticker, q.ticker) AS ticker, coalesce(f.year, q.year) AS year, coalesce(f.v, q.v) AS v, (f.v IS NULL AND q.v IS NOT NULL) AS stood_in
  FROM (SELECT * FROM eur WHERE quarter IS NULL) f FULL JOIN (SELECT * FROM eur WHERE quarter = 4) q ON f.ticker = q.ticker AND f.year = q.year),
t AS (
  SELECT ticker, year, CAST(NULL AS INT) AS quarter, v AS value, stood_in, 'FY(y)' AS formula FROM ends
  UNION ALL
  SELECT e.ticker, e.year, e.quarter, p.v + e.v - s.v, p.stood_in, 'FY(y-1) + YTD(y) - YTD(y-1)'
  FROM eur e LEFT JOIN ends p ON p.ticker = e.ticker AND p.year = e.year - 1
  LEFT JOIN eur s ON s.ticker = e.ticker AND s.year = e.year - 1 AND s.quarter = e.quarter WHERE e.quarter < 4)"""

ORACLES = {
    "preferred_report": f"WITH {_REPORTS} SELECT issuer, period_key, period_label, local_path, period_candidates, {_SCOPE} FROM ranked WHERE rk = 1",
    "candidate_reports": f"WITH {_REPORTS}, c AS (SELECT *, max(coalesce(consolidated, 0)) OVER (PARTITION BY issuer, period_key) AS has FROM ranked) SELECT issuer, period_key, local_path FROM c WHERE CASE WHEN has = 1 THEN consolidated = 1 ELSE rk = 1 END",
    "coverage": f"""WITH {_REPORTS}, s AS (SELECT *, CASE WHEN quarter IS NULL THEN 'FY' ELSE 'Q' || quarter END AS slot FROM keyed WHERE year IS NOT NULL),
      b AS (SELECT *, row_number() OVER (PARTITION BY issuer, year, slot ORDER BY scope_rank DESC, audit_rank, source_publish_date DESC NULLS LAST, local_path DESC) AS k FROM s)
      SELECT issuer, year, max(local_path) FILTER (slot = 'Q1') AS q1, max(local_path) FILTER (slot = 'Q2') AS q2, max(local_path) FILTER (slot = 'Q3') AS q3, max(local_path) FILTER (slot = 'Q4') AS q4, max(local_path) FILTER (slot = 'FY') AS fy
      FROM b WHERE k = 1 GROUP BY issuer, year""",
    "latest_metric": f"""WITH {_REPORTS}, {_METRICS}, j AS (
      SELECT r.issuer, m.metric, m.value, m.unit, m.local_path, row_number() OVER (PARTITION BY r.issuer, m.metric ORDER BY r.period_end DESC NULLS LAST, r.source_publish_date DESC NULLS LAST, m.local_path DESC) AS k
      FROM metric_values m JOIN ranked r ON r.local_path = m.local_path AND r.rk = 1) SELECT issuer, metric, value, unit, local_path FROM j WHERE k = 1""",
    "report_sources": f"WITH {_REPORTS} SELECT source_url, count(*) AS n, string_agg(DISTINCT local_path, ',' ORDER BY local_path) AS paths FROM reports GROUP BY source_url HAVING count(*) > 1",
    "field_availability": f"""WITH {_REPORTS}, {_METRICS}, h AS (SELECT local_path, count(*) AS n FROM metric_values WHERE value IS NOT NULL GROUP BY 1)
      SELECT issuer, period_key, coalesce(n, 0) AS available, (SELECT count(DISTINCT metric) FROM metric_values) AS known FROM ranked r LEFT JOIN h ON h.local_path = r.local_path WHERE rk = 1""",
    "report_periods": f"WITH {_REPORTS} SELECT local_path, period_key, period_label, CAST(datediff('day', period_start, period_end) AS INT) AS days, nullif(lower(regexp_extract(local_path, '\\.([A-Za-z0-9]{{1,8}})$', 1)), '') AS kind FROM keyed",
    "yearly_ratio": f"""WITH {_REPORTS}, {_METRICS}, p AS (
        SELECT * FROM (SELECT issuer, year, local_path, row_number() OVER (PARTITION BY issuer, year ORDER BY source_publish_date DESC NULLS LAST, local_path DESC) AS k FROM ranked WHERE rk = 1 AND quarter IS NULL AND year IS NOT NULL) WHERE k = 1),
      w AS (SELECT p.issuer, p.year, max(value) FILTER (metric = 'netincomeparentytd') AS ni, max(value) FILTER (metric = 'equityparent') AS eq, max(value) FILTER (metric = 'ebitytd') AS ebit, max(value) FILTER (metric = 'salesrevenueytd') AS sales
        FROM p LEFT JOIN metric_values m ON m.local_path = p.local_path GROUP BY p.issuer, p.year)
      SELECT w.issuer AS ticker, w.year, round(w.ni / nullif((o.eq + w.eq) / 2, 0), 6) AS roe, round(w.ebit / nullif(w.sales, 0), 6) AS ebit_margin FROM w LEFT JOIN w o ON o.issuer = w.issuer AND o.year = w.year - 1""",
    "ttm": f"WITH {_FLOWS}, {_TTM} SELECT ticker, 'sales' AS metric, year, quarter, round(value, 2) AS value, CASE WHEN value IS NULL THEN 'unavailable' WHEN stood_in THEN 'ttm-q4-fallback' ELSE 'ttm' END AS quality, formula FROM t",
    "growth": f"""WITH {_FLOWS}, {_TTM}, y AS (SELECT ticker, year, value AS v FROM t WHERE quarter IS NULL)
      SELECT a.ticker, a.year, round(a.v, 2) AS value, """
    + ", ".join(f"round(CASE WHEN b{h}.v > 0 AND a.v > 0 THEN power(a.v / b{h}.v, CAST(1 AS DOUBLE) / CAST({h} AS DOUBLE)) - 1 END, 6) AS cagr_{h}y" for h in (1, 3, 5))
    + " FROM y a " + " ".join(f"LEFT JOIN y b{h} ON b{h}.ticker = a.ticker AND b{h}.year = a.year - {h}" for h in (1, 3, 5)),
    "annual_trends": f"""WITH {_FLOWS}, {_TTM}, y AS (SELECT ticker, year, value AS v FROM t WHERE quarter IS NULL),
      j AS (SELECT a.ticker, a.year, round(a.v, 2) AS value, round((a.v - b.v) / nullif(abs(b.v), 0) * 100, 4) AS yoy, row_number() OVER (PARTITION BY a.ticker ORDER BY a.year DESC) AS k FROM y a LEFT JOIN y b ON b.ticker = a.ticker AND b.year = a.year - 1)
      SELECT ticker, year, value, yoy FROM j WHERE k <= 5""",
    "period_compare": f"WITH {_FLOWS}, {_TTM} SELECT ticker, " + ", ".join(f"round(max(value) FILTER (year = {k}), 2) AS y{k}" for k in range(1996, 2001)) + " FROM t WHERE quarter IS NULL GROUP BY ticker",
    "period_years": f"WITH {_FLOWS}, {_TTM} SELECT ticker, map_from_entries(list((year, round(value, 2)) ORDER BY year)) AS years FROM t WHERE quarter IS NULL GROUP BY ticker",
    "latest_snapshot": "SELECT key, snapshot_id, listed_quantity, updated_at FROM (SELECT upper(trim(ticker)) AS key, *, row_number() OVER (PARTITION BY upper(trim(ticker)) ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, snapshot_id DESC) AS k FROM securities) WHERE k = 1",
    "snapshot_history": "SELECT user_id, CAST(n AS INT) AS n, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5",
    "asof_profile": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE k = 1",
}
