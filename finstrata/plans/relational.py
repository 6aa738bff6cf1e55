"""Queries of joins, set operations, merges and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finstrata.functions import exprs as E
from finstrata.operators import ranking, store
from finstrata.operators import relational as R
from finstrata.plans.reports import _REPORTS, reports
from finstrata.session import table


def dup_groups(spark, sf_dir):
    return store.duplicates(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), ["source", "text"])


def dup_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids")).filter("n > 1")


def integrity(spark, sf_dir):
    """Counts of six checks over reports, facts, metrics and documents."""
    raw, r = table(spark, sf_dir, "parsed_reports"), reports(spark, sf_dir)
    paths = r.select("local_path")
    f, m = table(spark, sf_dir, "facts"), table(spark, sf_dir, "metrics")
    d = table(spark, sf_dir, "documents")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    parts = [
        count("repeated reports", store.duplicates(raw, ["local_path"])), count("orphan facts", f.join(paths, "local_path", "left_anti")), count("orphan metrics", m.join(paths, "local_path", "left_anti")),
        count("shared sources", store.duplicates(r, ["source_url"])), count("shared hashes", store.duplicates(r.filter("source_sha256 IS NOT NULL"), ["source_sha256"])), count("texts without text", d.filter("coalesce(trim(text), '') = ''")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repair_keep(spark, sf_dir):
    """Metrics rows left after orphans and repetitions are removed: the row parsed last, then the highest value."""
    order = [F.col("parsed_at").desc_nulls_last(), F.col("value").desc_nulls_last(), F.col("quality").desc_nulls_last(), F.col("note").desc_nulls_last()]
    return store.repair_keep(table(spark, sf_dir, "metrics"), reports(spark, sf_dir), "local_path", ["local_path", "metric_name"], order).select("local_path", "metric_name", "value", "parsed_at")


def orphans(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.join(table(spark, sf_dir, "orders"), c.c_custkey == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def referenced_flag(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    big = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50")
    return R.with_flag(p, big, "p_partkey", "l_partkey", "referenced")


def dataset_counts(spark, sf_dir):
    """Per issuer the number of reports, facts and metrics, 0 where there are none."""
    base = reports(spark, sf_dir).filter("issuer_code IS NOT NULL").groupBy("issuer_code").agg(F.count(F.lit(1)).alias("reports"))
    for t in ("facts", "metrics"):
        base = base.join(table(spark, sf_dir, t).groupBy("issuer_code").agg(F.count(F.lit(1)).alias(t)), "issuer_code", "left")
    return base.select("issuer_code", "reports", *[F.coalesce(t, F.lit(0)).alias(t) for t in ("facts", "metrics")])


def argmax_join(spark, sf_dir):
    """The rows of each issuer's latest period."""
    r = reports(spark, sf_dir)
    last = r.groupBy("issuer_code").agg(F.max("period_end").alias("period_end"))
    return r.join(last, ["issuer_code", "period_end"]).select("issuer_code", "period_end", "local_path")


def merge_precedence(spark, sf_dir):
    """A name for each key: the supplier's, else the customer's, else the nation's."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))
    return R.merge_precedence([s, c, n], "k", "name")


def pairwise_overlap(spark, sf_dir):
    """Issuers that report the same rare metrics."""
    m = table(spark, sf_dir, "metrics").filter("issuer_code IS NOT NULL").withColumn("metric", F.regexp_replace(F.lower("metric_name"), "[^a-z0-9]+", ""))
    return R.shared_items(m.filter("metric IN ('orderbacklog', 'overnightstays', 'occupancyrate', 'berths', 'fleetunits', 'installedpowermw')"), "issuer_code", "metric")


def metric_overlap(spark, sf_dir):
    """Issuers that report the same metrics, of all metrics, and what only either reports."""
    m = table(spark, sf_dir, "metrics").withColumn("metric", F.regexp_replace(F.lower("metric_name"), "[^a-z0-9]+", ""))
    return R.overlaps(m, "issuer_code", "metric")


def set_gap(spark, sf_dir):
    """Paths that only facts or only metrics know."""
    return R.set_differences(table(spark, sf_dir, "facts").filter("local_path IS NOT NULL"), table(spark, sf_dir, "metrics").filter("local_path IS NOT NULL"), "local_path")


def _events(spark, sf_dir, old: bool):
    e = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = e.filter(F.col("ts") < cut if old else F.col("ts") >= cut)
    return e.select("user_id", "event_type", "event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def _state(spark, sf_dir, old: bool):
    return ranking.best_per_group(_events(spark, sf_dir, old), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])


def upsert_last(spark, sf_dir):
    return store.upsert_last(_events(spark, sf_dir, True), _events(spark, sf_dir, False), ["user_id", "event_type"], ["ts", "event_id"])


def upsert_keep_old(spark, sf_dir):
    return store.upsert_keep(_state(spark, sf_dir, True), _state(spark, sf_dir, False), ["user_id", "event_type"], "old")


def upsert_keep_new(spark, sf_dir):
    return store.upsert_keep(_state(spark, sf_dir, True), _state(spark, sf_dir, False), ["user_id", "event_type"], "new")


def upsert_some(spark, sf_dir):
    """Only the value of rows both have is updated."""
    return store.upsert_keep(_state(spark, sf_dir, True), _state(spark, sf_dir, False), ["user_id", "event_type"], "new", update=["value"])


def replace_snapshot(spark, sf_dir):
    return store.replace_snapshot(_events(spark, sf_dir, True), _events(spark, sf_dir, False).filter("event_type = 'signup'"), ["user_id"]).select("event_id", "user_id", "event_type")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "facts", "metrics", "parsed_reports", "securities")


def row_counts(spark, sf_dir):
    out = None
    for t in TABLES:
        d = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = d if out is None else out.unionByName(d)
    return out


def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.lower("lang").alias("lang"), "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("issuer_code").alias("issuers"))


def bounded_selection(spark, sf_dir):
    """The first three texts of each issuer in publication order, each text once."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND issuer_code IS NOT NULL")
    one = ranking.best_per_group(d.withColumn("h", F.sha2("text", 256)), ["issuer_code", "h"], [F.col("publish_date").asc_nulls_last(), F.col("doc_id").asc()])
    return ranking.best_per_group(one, ["issuer_code"], [F.col("publish_date").asc_nulls_last(), F.col("doc_id").asc()], 3, "place").select("issuer_code", "place", "doc_id")


def label_search(spark, sf_dir):
    p = table(spark, sf_dir, "facts").select("statement", "adp_code", "label").filter("label IS NOT NULL").distinct()
    return R.search_labels(p, "NOVAC", ["label"], [F.col(c).asc() for c in ("statement", "adp_code", "label")], 50)


def pending_docs(spark, sf_dir):
    """Reports of stated variants without facts, those of the default variant first, newest first."""
    r = reports(spark, sf_dir).withColumn("variant", F.coalesce("source_variant", F.lit("issuer")))
    r = r.filter(F.upper("issuer_code").isin("HVDGR", "QJHGSC") & (F.col("variant").isin("issuer", "exchange") | F.col("source_publish_date").isNull()))
    f = table(spark, sf_dir, "facts").filter("value IS NULL").select("local_path")
    r = r.join(f, "local_path", "left_semi")
    return r.orderBy(F.when(F.col("variant") == "issuer", 0).otherwise(1), F.col("source_publish_date").desc_nulls_last(), "local_path").limit(40).select("local_path", "variant")


def first_url(spark, sf_dir):
    """The first source of each issuer and year beside the number of its variants."""
    r = reports(spark, sf_dir).filter("year IS NOT NULL AND issuer_code IS NOT NULL")
    u = r.groupBy("issuer_code", "year").agg(F.min("source_url").alias("url"))
    v = r.groupBy("issuer_code", "year").agg(F.countDistinct("source_variant").alias("variants"))
    return u.join(v, ["issuer_code", "year"])


def structural_link(spark, sf_dir):
    """Brands linked to the group their number names where that group has a region's key, and the misses."""
    b = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("key", F.regexp_extract("p_brand", r"(\d)\d*$", 1).try_cast("int"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), "r_name")
    return b.join(r, "key", "left").select("p_brand", "key", "r_name", F.col("r_name").isNull().alias("missing"))


def dimension_inventory(spark, sf_dir):
    return R.inventory(table(spark, sf_dir, "events"), F.from_json("props", "map<string,string>"), 5)


def best_filing(spark, sf_dir):
    """The best report of each period: language of the source aside, fewest warnings, newest; unknown counts as many."""
    r = reports(spark, sf_dir).filter("period_end IS NOT NULL").withColumn("w", F.coalesce(F.json_array_length("warnings_json"), F.lit(999999)))
    return ranking.best_per_group(r, ["issuer_code", "period_end"], [F.col("w").asc(), F.col("source_publish_date").desc_nulls_last(), F.col("local_path").asc()]).select("issuer_code", "period_end", "local_path", "w")


def entity_id(spark, sf_dir):
    """The strongest identifier of each security: a valid ISIN, else exchange and ticker, else a hash of the name."""
    s = table(spark, sf_dir, "securities").select("isin", "ticker", "name").distinct()
    t = F.nullif(F.upper(F.trim("ticker")), F.lit(""))
    local = F.concat(F.lit("LOCAL:"), F.substring(F.sha2(F.lower(F.trim("name")), 256), 1, 20))
    return s.select("isin", "ticker", "name", F.coalesce(F.concat(F.lit("ISIN:"), E.isin_code(F.col("isin"))), F.concat(F.lit("TICKER:"), t), local).alias("entity_id"))


def url_parts(spark, sf_dir):
    r = reports(spark, sf_dir)
    return r.select("local_path", F.regexp_extract("source_url", "^([a-z]+):", 1).alias("scheme"), F.regexp_extract("source_url", r"/(\d+)/", 1).alias("number"), E.file_kind(F.col("local_path")).alias("kind"))


def scalar_suite(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    return o.select(
        "o_orderkey", E.ratio(p, F.col("o_custkey") - 10).alias("ratio"), E.clip(p / 1000, 50.0, 300.0).alias("clipped"), F.round(F.log10(p), 6).alias("log"),
        F.lower(F.col("o_orderpriority")).alias("folded"), F.regexp_extract("o_orderpriority", "^([0-9])", 1).try_cast("int").alias("rank"), F.format_string("%04d-Q%d", F.year("o_orderdate"), F.quarter("o_orderdate")).alias("period"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 12).alias("short"),
        E.european_number(F.concat(F.lit("1."), F.lpad(F.col("o_custkey").cast("string"), 3, "0"), F.lit(",5"))).alias("number"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        dup_groups, dup_hash, integrity, repair_keep, orphans, referenced_flag, dataset_counts, argmax_join, merge_precedence, pairwise_overlap, metric_overlap, set_gap,
        upsert_last, upsert_keep_old, upsert_keep_new, upsert_some, replace_snapshot, row_counts, category_counts, bounded_selection, label_search, pending_docs,
        first_url, structural_link, dimension_inventory, best_filing, entity_id, url_parts, scalar_suite,
    )
}

_CUT = "TIMESTAMP '2024-01-15 00:00:00'"
_EV = f"""e AS (SELECT user_id, event_type, event_id, ts, CASE WHEN event_type <> 'error' THEN value END AS value, ts < {_CUT} AS old FROM events),
s AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, old ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1),
o AS (SELECT * FROM s WHERE old), n AS (SELECT * FROM s WHERE NOT old)"""
_MERGE = "FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type"
_MK = "coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type"

ORACLES = {
    "dup_groups": "SELECT source, text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "dup_hash": "SELECT sha256(text) AS hash, count(*) AS n, list_sort(list(doc_id)) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "integrity": f"""WITH {_REPORTS} SELECT 'repeated reports' AS "check", count(*) AS n FROM (SELECT 1 FROM parsed_reports GROUP BY local_path HAVING count(*) > 1)
      UNION ALL SELECT 'orphan facts', count(*) FROM facts WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.local_path = facts.local_path)
      UNION ALL SELECT 'orphan metrics', count(*) FROM metrics WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.local_path = metrics.local_path)
      UNION ALL SELECT 'shared sources', count(*) FROM (SELECT 1 FROM reports GROUP BY source_url HAVING count(*) > 1)
      UNION ALL SELECT 'shared hashes', count(*) FROM (SELECT 1 FROM reports WHERE source_sha256 IS NOT NULL GROUP BY source_sha256 HAVING count(*) > 1)
      UNION ALL SELECT 'texts without text', count(*) FROM documents WHERE coalesce(trim(text, ' '), '') = ''""",
    "repair_keep": "SELECT local_path, metric_name, value, parsed_at FROM (SELECT *, row_number() OVER (PARTITION BY local_path, metric_name ORDER BY parsed_at DESC NULLS LAST, value DESC NULLS LAST, quality DESC NULLS LAST, note DESC NULLS LAST) AS k FROM metrics WHERE local_path IN (SELECT local_path FROM parsed_reports)) WHERE k = 1",
    "orphans": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "referenced_flag": "SELECT p_partkey, p_brand, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50) AS referenced FROM part",
    "dataset_counts": f"""WITH {_REPORTS} SELECT r.issuer_code, r.n AS reports, coalesce(f.n, 0) AS facts, coalesce(m.n, 0) AS metrics FROM (SELECT issuer_code, count(*) AS n FROM reports WHERE issuer_code IS NOT NULL GROUP BY 1) r
      LEFT JOIN (SELECT issuer_code, count(*) AS n FROM facts GROUP BY 1) f USING (issuer_code) LEFT JOIN (SELECT issuer_code, count(*) AS n FROM metrics GROUP BY 1) m USING (issuer_code)""",
    "argmax_join": f"WITH {_REPORTS} SELECT issuer_code, period_end, local_path FROM reports r WHERE period_end = (SELECT max(period_end) FROM reports x WHERE x.issuer_code = r.issuer_code)",
    "merge_precedence": "SELECT coalesce(s_suppkey, c_custkey, n_nationkey) AS k, coalesce(s_name, c_name, n_name) AS name, CAST(CASE WHEN s_name IS NOT NULL THEN 0 WHEN c_name IS NOT NULL THEN 1 ELSE 2 END AS INT) AS origin FROM supplier FULL JOIN customer ON c_custkey = s_suppkey FULL JOIN nation ON n_nationkey = coalesce(s_suppkey, c_custkey)",
    "pairwise_overlap": """WITH m AS (SELECT DISTINCT issuer_code, regexp_replace(lower(metric_name), '[^a-z0-9]+', '', 'g') AS metric FROM metrics WHERE issuer_code IS NOT NULL),
      r AS (SELECT * FROM m WHERE metric IN ('orderbacklog', 'overnightstays', 'occupancyrate', 'berths', 'fleetunits', 'installedpowermw'))
      SELECT a.issuer_code AS a, b.issuer_code AS b, count(*) AS shared FROM r a JOIN r b ON a.metric = b.metric AND a.issuer_code < b.issuer_code GROUP BY 1, 2""",
    "metric_overlap": """WITH m AS (SELECT issuer_code AS g, list_sort(list(DISTINCT regexp_replace(lower(metric_name), '[^a-z0-9]+', '', 'g'))) AS s FROM metrics WHERE issuer_code IS NOT NULL AND metric_name IS NOT NULL GROUP BY 1)
      SELECT a.g AS a, b.g AS b, len(list_intersect(a.s, b.s)) AS shared, list_sort(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS only_a, list_sort(list_filter(b.s, lambda x: NOT list_contains(a.s, x))) AS only_b
      FROM m a JOIN m b ON a.g < b.g AND list_has_any(a.s, b.s)""",
    "set_gap": """(SELECT local_path, 'left' AS side FROM (SELECT local_path FROM facts WHERE local_path IS NOT NULL EXCEPT SELECT local_path FROM metrics)) UNION ALL
      (SELECT local_path, 'right' FROM (SELECT local_path FROM metrics WHERE local_path IS NOT NULL EXCEPT SELECT local_path FROM facts))""",
    "upsert_last": f"WITH {_EV} SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1",
    "upsert_keep_old": f"WITH {_EV} SELECT {_MK}, coalesce(o.event_id, n.event_id) AS event_id, coalesce(o.ts, n.ts) AS ts, coalesce(o.value, n.value) AS value {_MERGE}",
    "upsert_keep_new": f"WITH {_EV} SELECT {_MK}, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.ts, o.ts) AS ts, coalesce(n.value, o.value) AS value {_MERGE}",
    "upsert_some": f"WITH {_EV} SELECT {_MK}, coalesce(o.event_id, n.event_id) AS event_id, coalesce(o.ts, n.ts) AS ts, coalesce(n.value, o.value) AS value {_MERGE}",
    "replace_snapshot": f"SELECT event_id, user_id, event_type FROM events WHERE (ts < {_CUT} AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= {_CUT} AND event_type = 'signup')) OR (ts >= {_CUT} AND event_type = 'signup')",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES),
    "category_counts": "SELECT lower(lang) AS lang, source, count(*) AS n, count(DISTINCT issuer_code) AS issuers FROM documents GROUP BY 1, 2",
    "bounded_selection": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY issuer_code, text ORDER BY publish_date NULLS LAST, doc_id) AS k FROM documents WHERE text IS NOT NULL AND issuer_code IS NOT NULL),
      p AS (SELECT issuer_code, doc_id, CAST(row_number() OVER (PARTITION BY issuer_code ORDER BY publish_date NULLS LAST, doc_id) AS INT) AS place FROM o WHERE k = 1) SELECT issuer_code, place, doc_id FROM p WHERE place <= 3""",
    "label_search": "SELECT DISTINCT statement, adp_code, label FROM facts WHERE contains(lower(label), 'novac') ORDER BY 1, 2, 3 LIMIT 50",
    "pending_docs": f"""WITH {_REPORTS} SELECT local_path, coalesce(source_variant, 'issuer') AS variant FROM reports
      WHERE upper(issuer_code) IN ('HVDGR', 'QJHGSC') AND (coalesce(source_variant, 'issuer') IN ('issuer', 'exchange') OR source_publish_date IS NULL) AND local_path IN (SELECT local_path FROM facts WHERE value IS NULL)
      ORDER BY CASE WHEN coalesce(source_variant, 'issuer') = 'issuer' THEN 0 ELSE 1 END, source_publish_date DESC NULLS LAST, local_path LIMIT 40""",
    "first_url": f"WITH {_REPORTS} SELECT issuer_code, year, min(source_url) AS url, count(DISTINCT source_variant) AS variants FROM reports WHERE year IS NOT NULL AND issuer_code IS NOT NULL GROUP BY 1, 2",
    "structural_link": "SELECT p_brand, key, r_name, r_name IS NULL AS missing FROM (SELECT DISTINCT p_brand, TRY_CAST(regexp_extract(p_brand, '(\\d)\\d*$', 1) AS INT) AS key FROM part) LEFT JOIN region ON r_regionkey = key",
    "dimension_inventory": """WITH m AS (SELECT unnest(json_keys(props)) AS dimension, props FROM events), n AS (SELECT dimension, props ->> dimension AS member, count(*) AS n FROM m GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, member NULLS LAST) AS place FROM n) SELECT dimension, member, n, CAST(place AS INT) AS place FROM r WHERE place <= 5""",
    "best_filing": f"""WITH {_REPORTS} SELECT issuer_code, period_end, local_path, w FROM (SELECT *, CAST(coalesce(json_array_length(warnings_json), 999999) AS INT) AS w, row_number() OVER (PARTITION BY issuer_code, period_end ORDER BY coalesce(json_array_length(warnings_json), 999999), source_publish_date DESC NULLS LAST, local_path) AS k
      FROM reports WHERE period_end IS NOT NULL) WHERE k = 1""",
    "entity_id": """SELECT DISTINCT isin, ticker, name, coalesce('ISIN:' || CASE WHEN regexp_matches(upper(trim(isin, ' ')), '^[A-Z]{2}[A-Z0-9]{9}[0-9]$') THEN upper(trim(isin, ' ')) END, 'TICKER:' || nullif(upper(trim(ticker, ' ')), ''), 'LOCAL:' || substr(sha256(lower(trim(name, ' '))), 1, 20)) AS entity_id FROM securities""",
    "url_parts": f"WITH {_REPORTS} SELECT local_path, regexp_extract(source_url, '^([a-z]+):', 1) AS scheme, regexp_extract(source_url, '/(\\d+)/', 1) AS number, nullif(lower(regexp_extract(local_path, '\\.([A-Za-z0-9]{{1,8}})$', 1)), '') AS kind FROM reports",
    "scalar_suite": """SELECT o_orderkey, o_totalprice / nullif(CAST(o_custkey - 10 AS DOUBLE), 0) AS ratio, greatest(50.0, least(300.0, o_totalprice / 1000)) AS clipped, round(log10(o_totalprice), 6) AS log,
      lower(o_orderpriority) AS folded, TRY_CAST(regexp_extract(o_orderpriority, '^([0-9])', 1) AS INT) AS rank, printf('%04d-Q%d', year(o_orderdate), quarter(o_orderdate)) AS period,
      CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS short, CAST('1' || lpad(CAST(o_custkey AS VARCHAR), 3, '0') || '.5' AS DOUBLE) AS number FROM orders""",
}
