"""Queries p1-p4: drift, history, units and wide tables over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.operators import history as hist
from finstrata.operators import drift, units, wide
from finstrata.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.history(table(spark, sf_dir, "securities")).select("ticker", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


def p3_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.to_base(table(spark, sf_dir, "facts"), table(spark, sf_dir, "parsed_reports"), table(spark, sf_dir, "currency_rates"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p3_amounts(spark, sf_dir).filter("currency <> 'EUR' OR scale <> 1")
    return rows.select("fact_id", F.round("amount").cast("bigint").alias("value_eur"))


#: Attributes that count things; one with decimals is kept as a cast failure.
COUNTS = {"berths": "bigint", "employeesperiodend": "bigint", "fleetunits": "bigint", "overnightstays": "bigint"}


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = wide.resolve(wide.pairs(table(spark, sf_dir, "facts"), table(spark, sf_dir, "metrics")))
    return wide.to_wide(resolved, wide.known_attributes(resolved), COUNTS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = wide.resolve(wide.pairs(table(spark, sf_dir, "facts"), table(spark, sf_dir, "metrics")))
    names = wide.known_attributes(resolved)
    return wide.cells(wide.to_wide(resolved, names), names).select("local_path", "attribute", F.round(F.col("value") * 1_000_000).cast("bigint").alias("value_micro"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift(table(spark, sf_dir, "facts_landing")).changes().select("file_id", "change_kind", "field_name")


def p1_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_facts(table(spark, sf_dir, "facts_landing"))


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.history(table(spark, sf_dir, "securities"))


def p2_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of each attribute on its own, whose boundaries united begin the versions."""
    return hist.attribute_intervals(hist.snapshot_states(table(spark, sf_dir, "securities"))).select("ticker", "attribute", "valid_from", "valid_to", "key")


QUERIES = {
    "p1_found": p1_found, "p1_facts": p1_facts, "p2_found": p2_found, "p2_history": p2_history, "p2_attributes": p2_attributes,
    "p3_found": p3_found, "p3_amounts": p3_amounts, "p4_found": p4_found, "p4_wide": p4_wide,
}

_KNOWN = {
    "EUR": "['€','eur','euro','eura','euri','euros','eurima','keur','eurm','teur']", "HRK": "['hrk','kn','kuna','kune','kunama','thrk','hrkm','khrk']",
    "BAM": "['bam','km','marka','maraka']", "RSD": "['rsd','din','dinar','dinara','dinari']", "USD": "['usd','us$','$','dolara','us$m','usdm']",
}
_THOUSAND = "['''000','000','tis','tisuća','tisuće','tisućama','hiljada','hiljadama','thousand','thousands','keur','thrk','teur','khrk']"
_MILLION = "['mil','m','mio','million','millions','milijuna','milijunima','miliona','milionima','eurm','hrkm','us$m','usdm']"
_FILL = "['in','u','of','']"


def _unit_sql(x: str, name: str) -> str:
    """Columns <name>_c and <name>_s: what text x states if all its words are known."""
    words = f"string_split_regex(trim(regexp_replace(lower({x}), '[\\s\\x{{00A0}}.,/()\\[\\]-]+', ' ', 'g')), ' ')"
    every = "||".join(f"{v}" for v in [*_KNOWN.values(), _THOUSAND, _MILLION, _FILL])
    ok = f"len(list_filter({words}, lambda w: NOT list_contains({every}, w))) = 0"
    cur = " ".join(f"WHEN list_has_any({words}, {v}) THEN '{k}'" for k, v in _KNOWN.items())
    return f"CASE WHEN {ok} THEN CASE {cur} END END AS {name}_c, CASE WHEN {ok} THEN CASE WHEN list_has_any({words}, {_THOUSAND}) THEN 1000.0 WHEN list_has_any({words}, {_MILLION}) THEN 1000000.0 END END AS {name}_s"


_TICKER = "upper(regexp_replace(ticker, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'))"

_STATES = f"""WITH s AS (
        SELECT * FROM (SELECT {_TICKER} AS t, *, row_number() OVER (PARTITION BY {_TICKER}, updated_at ORDER BY ingested_at DESC, snapshot_id DESC) AS k FROM securities WHERE updated_at IS NOT NULL) WHERE k = 1 AND t <> ''),
      n AS (SELECT t, updated_at, sector, listed_quantity AS q,
          nullif(trim(regexp_replace(replace(lower(strip_accents(sector)), 'đ', 'd'), '[\\s\\x{{00A0}}]+', ' ', 'g')), '') AS sec,
          CASE WHEN coalesce(regexp_replace(delisting_date, '\\s+', '', 'g'), '') IN ('', '-') THEN '-'
            WHEN regexp_matches(trim(delisting_date), '^\\d{{4}}-') THEN trim(delisting_date)
            ELSE strftime(make_date(CAST(regexp_extract(delisting_date, '(\\d{{4}})', 1) AS INT), CAST(regexp_extract(delisting_date, '^\\s*\\d+[./](\\d+)', 1) AS INT), CAST(regexp_extract(delisting_date, '^\\s*(\\d+)', 1) AS INT)), '%Y-%m-%d') END AS del
        FROM s)"""
_STARTS = """p AS (SELECT *, row_number() OVER w AS k, last_value(sec IGNORE NULLS) OVER b AS psec, last_value(q IGNORE NULLS) OVER b AS pq, last_value(del) OVER b AS pdel FROM n
        WINDOW w AS (PARTITION BY t ORDER BY updated_at), b AS (PARTITION BY t ORDER BY updated_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
#: Each attribute's changes: stated values that differ from the one stated before.
_LOG = """l AS (SELECT t, updated_at AS ts, 'sector' AS attribute, sec AS key, sector AS raw FROM n WHERE sec IS NOT NULL UNION ALL SELECT t, updated_at, 'listed_quantity', CAST(q AS VARCHAR), CAST(q AS VARCHAR) FROM n WHERE q IS NOT NULL
        UNION ALL SELECT t, updated_at, 'delisting_date', del, del FROM n),
      log AS (SELECT * FROM l QUALIFY key IS DISTINCT FROM lag(key) OVER (PARTITION BY t, attribute ORDER BY ts))"""


def _held(attribute: str, value: str) -> str:
    return f"(SELECT arg_max({value}, ts) FROM log WHERE log.t = v.t AND attribute = '{attribute}' AND (v.until IS NULL OR log.ts < v.until))"


ORACLES = {
    "p2_found": f"""{_STATES},
      {_STARTS}
      SELECT t AS ticker, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS valid_from FROM p WHERE k = 1 OR coalesce(sec <> psec, false) OR coalesce(q <> pq, false) OR del <> pdel""",
    "p2_attributes": f"""{_STATES}, {_LOG} SELECT t AS ticker, attribute, ts AS valid_from, lead(ts) OVER (PARTITION BY t, attribute ORDER BY ts) AS valid_to, key FROM log""",
    "p2_history": f"""{_STATES}, {_LOG}, {_STARTS},
      v AS (SELECT t, updated_at AS since, lead(updated_at) OVER (PARTITION BY t ORDER BY updated_at) AS until FROM p WHERE k = 1 OR coalesce(sec <> psec, false) OR coalesce(q <> pq, false) OR del <> pdel)
      SELECT t AS ticker, since AS valid_from, until AS valid_to, {_held('sector', 'raw')} AS sector, CAST({_held('listed_quantity', 'raw')} AS BIGINT) AS listed_quantity, nullif({_held('delisting_date', 'key')}, '-') AS delisting_date FROM v""",
    "p3_found": f"""WITH r AS (SELECT local_path, max(CASE {" ".join(f"WHEN list_contains({v}, replace(lower(trim(currency)), '.', '')) THEN '{k}'" for k, v in _KNOWN.items())} END) AS r_c, max(scale) AS r_s, max(coalesce(year(period_end), year)) AS r_y FROM parsed_reports GROUP BY 1),
      f AS (SELECT fact_id, local_path, value, unit, regexp_extract(label, '(?:[(\\[][^()\\[\\]]*[)\\]]|(?:[,;:]|\\s[–-]\\s)[^,;:()\\[\\]–-]*)\\s*$') AS m FROM facts WHERE statement <> 'general_data' AND value IS NOT NULL),
      u AS (SELECT fact_id, local_path, value, {_unit_sql("nullif(trim(regexp_replace(m, '[,;:–()\\[\\]]', ' ', 'g')), '')", "l")}, {_unit_sql("nullif(trim(unit), '')", "u")} FROM f),
      c AS (SELECT fact_id, value, coalesce(l_c, u_c, r_c, CASE WHEN coalesce(r_y, TRY_CAST(regexp_extract(u.local_path, '/((?:19|20)\\d\\d)/', 1) AS INT)) <= 2022 THEN 'HRK' ELSE 'EUR' END) AS currency, coalesce(l_s, u_s, r_s, 1) AS scale
        FROM u LEFT JOIN r ON r.local_path = u.local_path)
      SELECT fact_id, CAST(round(value * (scale / units_per_eur)) AS BIGINT) AS value_eur FROM c JOIN currency_rates USING (currency) WHERE currency <> 'EUR' OR scale <> 1""",
    "p4_found": """WITH p AS (
        SELECT local_path, regexp_replace(lower(metric_name), '[^a-z0-9]+', '', 'g') AS attribute, value, parsed_at, 0 AS tie FROM metrics
        UNION ALL SELECT local_path, 'balancesheet.' || adp_code || '.' || regexp_replace(lower(column_name), '[^a-z0-9]+', '', 'g'), value, parsed_at, fact_id FROM facts WHERE statement = 'balance_sheet'),
      k AS (SELECT *, row_number() OVER (PARTITION BY local_path, attribute ORDER BY parsed_at DESC NULLS LAST, tie DESC, value DESC) AS k FROM p WHERE local_path IS NOT NULL AND attribute <> '' AND value IS NOT NULL)
      SELECT local_path, attribute, CAST(round(value * 1000000) AS BIGINT) AS value_micro FROM k WHERE k = 1""",
}
