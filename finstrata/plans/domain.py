"""Queries of mappings, trees, series, similarity and text evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finstrata.functions import exprs as E
from finstrata.functions.text import alnum_key, fold
from finstrata.operators import evidence as V
from finstrata.operators import graphs as G
from finstrata.operators import series as T
from finstrata.operators import similarity as P
from finstrata.operators import ranking
from finstrata.plans.reports import _METRICS, _REPORTS, metric_values, reports
from finstrata.session import table

# --- mappings and trees -------------------------------------------------------------------


def _ticker():
    return F.upper(F.trim("ticker"))


def _mappings(spark, sf_dir):
    s = table(spark, sf_dir, "securities").filter("isin IS NOT NULL AND trim(ticker) <> ''")
    m = table(spark, sf_dir, "metrics").filter("metric_name IS NOT NULL")
    e = lambda d, scope, a, b: d.select(F.lit(scope).alias("scope"), a.alias("src"), b.alias("dst"))
    return e(s, "isin", F.col("isin"), _ticker()).unionByName(e(s.filter("sector IS NOT NULL"), "sector", _ticker(), F.col("sector"))).unionByName(e(m, "metric", F.col("metric_name"), alnum_key(F.col("metric_name"))))


def mapping_shape(spark, sf_dir):
    return G.mapping_shape(_mappings(spark, sf_dir), ["scope"])


def _crosswalk(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    node = lambda system, x: F.concat(F.lit(f"{system}:"), x.cast("string"))
    a = c.select(node("segment", F.col("c_mktsegment")).alias("src"), node("nation", F.col("n_name")).alias("dst")).distinct()
    b = table(spark, sf_dir, "nation").select(node("nation", F.col("n_name")).alias("src"), node("region", F.col("n_regionkey")).alias("dst"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(node("supplier", F.col("s_suppkey")).alias("src"), node("nation", F.col("n_name")).alias("dst"))
    r = table(spark, sf_dir, "region").select(node("region", F.col("r_regionkey")).alias("src"), node("world", F.lit(1)).alias("dst"))
    return a.unionByName(b).unionByName(s).unionByName(r)


def crosswalk_paths(spark, sf_dir):
    """From every segment and supplier, and from names no edge knows, to the regions and beyond them."""
    e = _crosswalk(spark, sf_dir)
    starts = e.filter("src LIKE 'segment:%' OR src LIKE 'supplier:%'").select(F.col("src").alias("start")).distinct().unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("unknown:"), "n_name").alias("start")))
    return G.translations(e, starts, "world").select("start", F.array_join("path", " > ").alias("path"), "hops")


def _tree(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    return n.unionByName(c).unionByName(r)


def taxonomy_closure(spark, sf_dir):
    return G.closure(_tree(spark, sf_dir)).select("node", "ancestor", "depth", F.array_join("path", "/").alias("path"))


def _codes(spark, sf_dir):
    """A published list: sections A.. by region, two-digit divisions by nation, groups by segment, in file order."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 100_000).alias("pos"), F.char(F.col("r_regionkey") + 65).alias("code"))
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 100_000 + F.col("n_nationkey") * 1000 + 1).alias("pos"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"))
    seg = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", F.length("c_mktsegment").alias("k")).distinct()
    g = seg.select((F.col("n_regionkey") * 100_000 + F.col("n_nationkey") * 1000 + 1 + F.col("k")).alias("pos"), F.concat(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("."), (F.col("k") % 10).cast("string")).alias("code"))
    return r.unionByName(n).unionByName(g).withColumn("level", G.code_level(F.col("code")))


def parent_fill(spark, sf_dir):
    return G.fill_parents(_codes(spark, sf_dir).withColumn("scheme", F.lit("demo")), ["scheme"], "pos", "level", "code").select("pos", "code", "level", "parent")


def level_counts(spark, sf_dir):
    return G.level_counts(_codes(spark, sf_dir), {1: 5, 2: 25, 3: 100, 4: 0})


# --- series -------------------------------------------------------------------------------


def _revenue(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return li.join(o, "l_orderkey").join(p, "l_partkey").groupBy("p_type", "year").agg(F.sum("amount").cast("double").alias("value"))


def series_growth(spark, sf_dir):
    return T.series_growth(_revenue(spark, sf_dir), ["p_type"])


def series_direction(spark, sf_dir):
    return T.series_direction(_revenue(spark, sf_dir), ["p_type"])


def market_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "revenue").when((F.col("o_orderstatus") == "P") & (F.col("n_regionkey") == 1), "contract").otherwise("mention")
    e = o.select(F.col("n_name").alias("market"), kind.alias("kind"), F.year("o_orderdate").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    m = T.market_profile(e, 4.0)
    return m.select("market", F.array_join("kinds", ",").alias("kinds"), F.array_join("periods", ",").alias("periods"), "share", "core", "status")


# --- similarity ---------------------------------------------------------------------------


def _activities(spark, sf_dir):
    """Revenue of each nation's suppliers by a four-digit code of size and brand; a third of the nations state no shares."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), F.substring("p_brand", -2, 2)).alias("code"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("ticker"), "n_regionkey")
    a = li.join(p, "l_partkey").join(s, "l_suppkey").groupBy("ticker", "code", "n_regionkey").agg(F.sum("q").alias("q"))
    return a.select("ticker", "code", F.when(F.col("n_regionkey") != 2, F.col("q").cast("double")).alias("share"))


def activity_vector(spark, sf_dir):
    return P.activity_vector(_activities(spark, sf_dir)).select("ticker", "code", F.round("weight", 9).alias("weight"))


def peer_greedy(spark, sf_dir):
    g = P.greedy_match(P.activity_vector(_activities(spark, sf_dir)), "NATION_7")
    return g.withColumn("band", P.business_band(F.col("score"), F.col("exact"), F.col("same_group")))


# Bounds, scale and weight of the ratios compared.
SCALES = {
    "ebit_margin": (-1.0, 1.0, 0.10, 1.00), "ebitda_margin": (-1.0, 1.5, 0.12, 1.00), "fcf_margin": (-1.5, 1.5, 0.12, 0.90), "capex_intensity": (0.0, 1.5, 0.08, 0.70), "cfo_to_ebitda": (-3.0, 5.0, 0.60, 0.70),
    "current_ratio": (0.0, 8.0, 1.00, 0.55), "debt_to_equity": (-3.0, 10.0, 1.00, 0.80), "net_debt_to_ebitda": (-10.0, 15.0, 2.00, 1.00), "interest_coverage": (-10.0, 30.0, 5.00, 0.55),
}
#: Where each comes from: a metric, or a ratio of two; the tables' metrics lack some, which are then null.
FEATURES = {
    "ebit_margin": ("ebitytd", "salesrevenueytd"), "ebitda_margin": ("ebitdasimpleytd", "salesrevenueytd"), "fcf_margin": ("fcfmarginytd", None), "capex_intensity": ("capexytd", "salesrevenueytd"), "cfo_to_ebitda": ("operatingcashflowytd", "ebitdasimpleytd"),
    "current_ratio": ("currentratio", None), "debt_to_equity": ("debttoequityparent", None), "net_debt_to_ebitda": ("netdebttoebitdarunrate", None), "interest_coverage": ("interestcoverageebit", None),
}
TARGET = "QJHGSC"


def _features(spark, sf_dir):
    m = ranking.latest_metrics(metric_values(spark, sf_dir), ranking.preferred_reports(reports(spark, sf_dir)))
    names = sorted({x for pair in FEATURES.values() for x in pair if x})
    w = m.groupBy(F.col("issuer").alias("ticker")).agg(*[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k) for k in names])
    return w.select("ticker", *[(F.col(a) if b is None else E.ratio(F.col(a), F.col(b))).alias(k) for k, (a, b) in FEATURES.items()])


def peer_fingerprint(spark, sf_dir):
    f = P.fingerprint_similarity(_features(spark, sf_dir), TARGET, SCALES)
    return f.select("ticker", F.round("similarity", 6).alias("similarity"), "common")


def name_similarity(spark, sf_dir):
    g = table(spark, sf_dir, "gleif_candidates").select("lei", "query_name", "legal_name", (F.col("query_country") != F.col("legal_address_country")).alias("conflict"))
    same = P.name_key(F.col("query_name")) == P.name_key(F.col("legal_name"))
    out = P.name_similarities(g, "query_name", "legal_name")
    return out.select("lei", "query_name", "legal_name", "similarity", P.candidate_class(same, F.col("similarity"), F.col("conflict")).alias("class"))


def candidate_class(spark, sf_dir):
    """The class of each candidate by the similarity the registry gave."""
    g = table(spark, sf_dir, "gleif_candidates")
    same = fold(F.col("query_name")) == fold(F.col("legal_name"))
    return g.select("lei", "query_name", P.candidate_class(same, F.col("name_similarity"), ~F.col("country_match")).alias("class"))


# --- evidence -----------------------------------------------------------------------------

#: Fixed values of the demonstration: rules of (id, node, aliases, required words) and the nodes' parents.
RULES = (
    ("R-WOOL", "textiles.wool", ("wool yarn", "vunenu predu"), ()), ("R-CABLE", "electrical.cables", ("cables", "kabele"), ()), ("R-SWITCH", "electrical.switchgear", ("switchgear", "sklopne blokove"), ()),
    ("R-FISH", "food.fish", ("canned fish", "riblje konzerve", "processing of fish"), ()), ("R-OIL", "food.oil", ("olive oil", "maslinovo ulje"), ()), ("R-BOND", "finance.debt", (), ("bonds", "loans")),
    ("R-HOTEL", "tourism.hotels", ("nights in the hotels",), ("hotels", "nights")),
)
PARENTS = {"textiles.wool": "textiles", "electrical.cables": "electrical", "electrical.switchgear": "electrical", "food.fish": "food", "food.oil": "food", "finance.debt": "finance", "tourism.hotels": "tourism", "textiles": "goods", "electrical": "goods", "food": "goods", "goods": None, "finance": None, "tourism": None}


def rule_match(spark, sf_dir):
    return V.match_rules(table(spark, sf_dir, "documents"), RULES)


def rule_profile(spark, sf_dir):
    tree = G.closure(spark.createDataFrame(list(PARENTS.items()), "node string, parent string"))
    return V.with_ancestors(V.match_rules(table(spark, sf_dir, "documents"), RULES), tree)


#: Fixed values of the demonstration: classes of texts in order.
CLASSES = (("MEETING", ("general meeting", "glavna skupstina")), ("DIVIDEND", ("dividend",)), ("DEBT", ("bonds", "net debt", "neto dug")), ("SEGMENT", ("segment",)))


def disclosure_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.ordered_class(F.col("text"), CLASSES).alias("class"))


def narrative_windows(spark, sf_dir):
    return V.term_windows(table(spark, sf_dir, "documents"), ("dividend", "net debt", "cables", "dionica"))


def annuality(spark, sf_dir):
    r = reports(spark, sf_dir).select("issuer_code", "period_start", F.date_add("period_end", 1).alias("until"), (F.col("consolidated") == 1).alias("core"))
    return V.annuality(r, "issuer_code", "period_start", "until", "core")


def value_flags(spark, sf_dir):
    """Numbers inside labels and units read the European way."""
    s = table(spark, sf_dir, "securities").filter("nominal_value IS NOT NULL").select("snapshot_id", "nominal_value")
    return s.select("snapshot_id", E.european_number(F.regexp_extract("nominal_value", r"^\s*([0-9.,]+)", 1)).alias("amount"), F.regexp_extract("nominal_value", r"([A-Z]{3})\s*$", 1).alias("currency"))


QUERIES = {
    f.__name__: f
    for f in (
        mapping_shape, crosswalk_paths, taxonomy_closure, parent_fill, level_counts, series_growth, series_direction, market_profile, activity_vector, peer_greedy, peer_fingerprint,
        name_similarity, candidate_class, rule_match, rule_profile, disclosure_class, narrative_windows, annuality, value_flags,
    )
}

_EDGES = """e AS (
  SELECT DISTINCT 'segment:' || c_mktsegment AS src, 'nation:' || n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'nation:' || n_name, 'region:' || n_regionkey FROM nation UNION SELECT 'supplier:' || s_suppkey, 'nation:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'region:' || r_regionkey, 'world:1' FROM region),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
starts AS (SELECT DISTINCT src AS start FROM e WHERE src LIKE 'segment:%' OR src LIKE 'supplier:%' UNION ALL SELECT 'unknown:' || n_name FROM nation)"""
_CODES = """c AS (
  SELECT r_regionkey * 100000 AS pos, chr(r_regionkey + 65) AS code, CAST(1 AS INT) AS level FROM region
  UNION ALL SELECT n_regionkey * 100000 + n_nationkey * 1000 + 1, lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 2 FROM nation
  UNION ALL SELECT DISTINCT n_regionkey * 100000 + n_nationkey * 1000 + 1 + CAST(length(c_mktsegment) AS INT), lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.' || (length(c_mktsegment) % 10), 3 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_REV = "r AS (SELECT p_type, CAST(year(o_orderdate) AS INT) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"
_PLAIN = "lower(replace(strip_accents(text), 'đ', 'd'))"
_SPACED = f"' ' || trim(regexp_replace(replace({_PLAIN}, 'Đ', 'd'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


def _rule_sql() -> str:
    out = []
    for rule, node, aliases, required in RULES:
        ok = " OR ".join(f"contains(t, ' {a} ')" for a in aliases) or "false"
        if required:
            ok += " OR (" + " AND ".join(f"contains(t, ' {x} ')" for x in required) + ")"
        out.append(f"SELECT doc_id, '{rule}' AS rule, '{node}' AS node FROM t WHERE {ok}")
    return f"t AS (SELECT doc_id, {_SPACED} AS t FROM documents WHERE text IS NOT NULL), m AS ({' UNION ALL '.join(out)})"


def _finger_sql() -> str:
    terms, weights, n = [], [], []
    for k, (lo, hi, scale, w) in SCALES.items():
        a = f"(1 / (1 + abs(greatest({lo}, least({hi}, f.{k})) - greatest({lo}, least({hi}, t.{k}))) / {scale}))"
        there = f"(f.{k} IS NOT NULL AND t.{k} IS NOT NULL)"
        terms.append(f"CASE WHEN {there} THEN {a} * {w} ELSE 0 END")
        weights.append(f"CASE WHEN {there} THEN {w} ELSE 0 END")
        n.append(f"CAST({there} AS INT)")
    value = lambda m: f"max(value) FILTER (metric = '{m}')"
    pick = ", ".join(f"{value(a)}{f' / nullif({value(b)}, 0)' if b else ''} AS {k}" for k, (a, b) in FEATURES.items())
    return f"""WITH {_REPORTS}, {_METRICS}, j AS (SELECT r.issuer, m.metric, m.value, row_number() OVER (PARTITION BY r.issuer, m.metric ORDER BY r.period_end DESC NULLS LAST, r.source_publish_date DESC NULLS LAST, m.local_path DESC) AS k
        FROM metric_values m JOIN ranked r ON r.local_path = m.local_path AND r.rk = 1),
      f AS (SELECT issuer AS ticker, {pick} FROM j WHERE k = 1 GROUP BY issuer), t AS (SELECT * FROM f WHERE ticker = '{TARGET}')
      SELECT f.ticker, round(CASE WHEN {' + '.join(n)} >= 4 THEN ({' + '.join(terms)}) / nullif({' + '.join(weights)}, 0) * 100 END, 6) AS similarity, CAST({' + '.join(n)} AS INT) AS common FROM f, t WHERE f.ticker <> '{TARGET}'"""


_CLASS_SQL = " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in CLASSES)

ORACLES = {
    "mapping_shape": """WITH e AS (SELECT DISTINCT * FROM (
        SELECT 'isin' AS scope, isin AS src, upper(trim(ticker, ' ')) AS dst FROM securities WHERE isin IS NOT NULL AND trim(ticker, ' ') <> ''
        UNION ALL SELECT 'sector', upper(trim(ticker, ' ')), sector FROM securities WHERE isin IS NOT NULL AND trim(ticker, ' ') <> '' AND sector IS NOT NULL
        UNION ALL SELECT 'metric', metric_name, regexp_replace(lower(metric_name), '[^a-z0-9]+', '', 'g') FROM metrics WHERE metric_name IS NOT NULL))
      SELECT scope, src, dst, CASE WHEN count(*) OVER (PARTITION BY scope, dst) > 1 THEN 'many' ELSE 'one' END || '_to_' || CASE WHEN count(*) OVER (PARTITION BY scope, src) > 1 THEN 'many' ELSE 'one' END AS shape FROM e""",
    "crosswalk_paths": f"""WITH RECURSIVE {_EDGES}, w AS (
        SELECT start, [start] AS path, start AS here, 0 AS hops FROM starts
        UNION ALL SELECT w.start, list_append(w.path, b.dst), b.dst, w.hops + 1 FROM w JOIN b ON b.src = w.here WHERE w.hops < 4 AND NOT list_contains(w.path, b.dst) AND w.here NOT LIKE 'world:%'),
      f AS (SELECT *, min(hops) OVER (PARTITION BY start) AS least FROM w WHERE here LIKE 'world:%')
      SELECT s.start, array_to_string(f.path, ' > ') AS path, CAST(f.hops AS INT) AS hops FROM starts s LEFT JOIN f ON f.start = s.start AND f.hops = f.least""",
    "taxonomy_closure": """WITH RECURSIVE t AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
      c AS (SELECT node, node AS ancestor, 0 AS depth, node AS path FROM t UNION ALL SELECT c.node, t.parent, c.depth + 1, c.path || '/' || t.parent FROM c JOIN t ON t.node = c.ancestor WHERE t.parent IS NOT NULL) SELECT node, ancestor, CAST(depth AS INT) AS depth, path FROM c""",
    "parent_fill": f"""WITH {_CODES} SELECT pos, code, level, CASE WHEN level > 1 THEN (SELECT CASE WHEN arg_max(u.level, u.pos) = c.level - 1 THEN arg_max(u.code, u.pos) END FROM c u WHERE u.pos < c.pos AND u.level < c.level) END AS parent FROM c""",
    "level_counts": f"WITH {_CODES}, n AS (SELECT level, count(*) AS n FROM c GROUP BY 1), x(level, expected) AS (VALUES (1, 5), (2, 25), (3, 100), (4, 0)) SELECT CAST(coalesce(n.level, x.level) AS INT) AS level, coalesce(n, 0) AS n, CAST(coalesce(expected, 0) AS BIGINT) AS expected, coalesce(n = expected, false) AS ok FROM n FULL JOIN x ON x.level = n.level",
    "series_growth": f"WITH {_REV} SELECT a.p_type, a.year, a.value, CAST(round_even((a.value - b.value) / nullif(abs(b.value), 0) * 100, 4) AS DOUBLE) AS yoy FROM r a LEFT JOIN r b ON b.p_type = a.p_type AND b.year = a.year - 1",
    "series_direction": f"""WITH {_REV}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY p_type ORDER BY year) AS step FROM r),
      g AS (SELECT p_type, count(*) AS points, bool_and(step > 0) AS up, bool_and(step < 0) AS down, bool_and(step = 0) AS flat, arg_min(value, year) AS a, arg_max(value, year) AS z, max(year) - min(year) AS years FROM d GROUP BY 1)
      SELECT p_type, points, CASE WHEN points < 2 THEN 'INSUFFICIENT' WHEN up THEN 'INCREASING' WHEN down THEN 'DECREASING' WHEN flat THEN 'STABLE' ELSE 'MIXED' END AS direction, CAST(round_even((z - a) / nullif(abs(a), 0) * 100, 4) AS DOUBLE) AS change,
        CAST(round_even(CASE WHEN a > 0 AND z >= 0 AND years > 0 THEN (power(z / a, CAST(1 AS DOUBLE) / years) - 1) * 100 END, 4) AS DOUBLE) AS cagr FROM g""",
    "market_profile": """WITH e AS (SELECT n_name AS market, CASE WHEN o_orderstatus = 'F' THEN 'revenue' WHEN o_orderstatus = 'P' AND n_regionkey = 1 THEN 'contract' ELSE 'mention' END AS kind, year(o_orderdate) AS period, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
      g AS (SELECT market, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, array_to_string(list_sort(list(DISTINCT period)), ',') AS periods, count(DISTINCT period) FILTER (kind = 'revenue') AS rp, bool_or(kind = 'contract') AS contract, CAST(sum(amount) AS DOUBLE) AS amount FROM e GROUP BY 1)
      SELECT market, kinds, periods, round(amount / (SELECT CAST(sum(amount) AS DOUBLE) FROM e) * 100, 4) AS share, amount / (SELECT CAST(sum(amount) AS DOUBLE) FROM e) * 100 >= 4 AS core, CASE WHEN contract THEN 'DIRECT' WHEN rp >= 2 THEN 'REPEATED' ELSE 'REPORTED' END AS status FROM g""",
    "activity_vector": """WITH a AS (SELECT n_name AS ticker, lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || right(p_brand, 2) AS code, n_regionkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
      w AS (SELECT ticker, code, CASE WHEN n_regionkey <> 2 THEN q ELSE 1 END AS w FROM a) SELECT ticker, code, round(w / sum(w) OVER (PARTITION BY ticker), 9) AS weight FROM w""",
    "peer_fingerprint": _finger_sql(),
    "candidate_class": "WITH g AS (SELECT *, trim(regexp_replace(replace(lower(strip_accents(query_name)), 'đ', 'd'), '[\\s\\x{00A0}]+', ' ', 'g')) = trim(regexp_replace(replace(lower(strip_accents(legal_name)), 'đ', 'd'), '[\\s\\x{00A0}]+', ' ', 'g')) AS same FROM gleif_candidates) SELECT lei, query_name, CASE WHEN coalesce(NOT country_match, false) THEN 'REVIEW' WHEN same THEN 'EXACT' WHEN name_similarity >= 0.92 THEN 'STRONG_REVIEW' ELSE 'REVIEW' END AS class FROM g",
    "rule_match": f"WITH {_rule_sql()} SELECT * FROM m",
    "rule_profile": f"""WITH RECURSIVE {_rule_sql()}, p(node, parent) AS (VALUES {', '.join(f"('{k}', {chr(39) + v + chr(39) if v else 'NULL'})" for k, v in PARENTS.items())}),
      u AS (SELECT DISTINCT doc_id, node FROM m), up AS (SELECT u.doc_id, p.parent AS node FROM u JOIN p USING (node) WHERE parent IS NOT NULL UNION SELECT up.doc_id, p.parent FROM up JOIN p USING (node) WHERE parent IS NOT NULL)
      SELECT doc_id, node, true AS explicit FROM u UNION ALL SELECT DISTINCT doc_id, node, false FROM up WHERE (doc_id, node) NOT IN (SELECT (doc_id, node) FROM u)""",
    "disclosure_class": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE {_CLASS_SQL} ELSE 'OTHER' END END AS class FROM (SELECT doc_id, text, regexp_replace({_PLAIN}, '[\\s\\p{{Z}}]+', ' ', 'g') AS t FROM documents)",
    "annuality": f"""WITH {_REPORTS}, y AS (SELECT issuer_code, coalesce(datediff('day', period_start, period_end) + 1 BETWEEN 320 AND 410, false) AS y, coalesce(consolidated = 1, false) AS core FROM reports),
      g AS (SELECT issuer_code, count(*) FILTER (y) AS annual_facts, count(*) FILTER (y AND core) AS core_facts FROM y GROUP BY 1) SELECT *, annual_facts >= 3 AND core_facts >= 1 AS annual FROM g""",
    "value_flags": "SELECT snapshot_id, TRY_CAST(replace(replace(regexp_extract(nominal_value, '^\\s*([0-9.,]+)', 1), '.', ''), ',', '.') AS DOUBLE) AS amount, regexp_extract(nominal_value, '([A-Z]{3})\\s*$', 1) AS currency FROM securities WHERE nominal_value IS NOT NULL",
}
