import datetime as dt

import pytest
from pyspark.sql import functions as F

from finstrata.operators import evidence as V
from finstrata.operators import graphs as G
from finstrata.operators import periods, ranking, relational, series, similarity, store
from finstrata.operators import statements as S
from finstrata.streaming import events as stream

FLOWS = "ticker string, year int, quarter int, metric string, value double, unit string"


def _ttm(spark, rows):
    return {(r.year, r.quarter, r.metric): (r.value, r.quality) for r in periods.ttm(spark.createDataFrame([("A", *x) for x in rows], FLOWS)).collect()}


def test_ttm_goldens(spark):
    got = _ttm(spark, [(2025, 2, "s", 400.0, "EUR"), (2025, None, "s", 1000.0, "EUR"), (2026, 2, "s", 500.0, "EUR")])
    assert got[2026, 2, "s"] == (1100.0, "ttm") and got[2025, None, "s"] == (1000.0, "ttm") and got[2025, 2, "s"] == (None, "unavailable")
    k = 7.5345
    got = _ttm(spark, [(2022, 1, "s", 100 * k, "HRK"), (2022, None, "s", 500 * k, "HRK"), (2023, 1, "s", 150.0, "EUR"), (2023, 2, "s", 9.0, "USD")])
    assert got[2023, 1, "s"][0] == pytest.approx(550.0) and got[2023, 2, "s"] == (None, "unavailable")


def test_ttm_fourth_quarter_stands_in(spark):
    got = _ttm(spark, [(2024, None, "r", None, "EUR"), (2024, 4, "r", 1000.0, "EUR"), (2024, 1, "r", 200.0, "EUR"), (2025, 1, "r", 300.0, "EUR"), (2025, None, "c", 92.0, "EUR"), (2026, 1, "c", 55.0, "EUR"), (2025, 1, "c", 35.0, "EUR")])
    assert got[2025, 1, "r"] == (1100.0, "ttm-q4-fallback") and got[2026, 1, "c"] == (112.0, "ttm") and got[2024, None, "r"] == (1000.0, "ttm-q4-fallback")


def test_growth_needs_the_exact_year(spark):
    y = spark.createDataFrame([("A", 2020, 100.0), ("A", 2025, 200.0), ("A", 2023, -5.0)], "ticker string, year int, value double")
    got = {r.year: r for r in periods.growth(y).collect()}
    assert got[2025].cagr_5y == pytest.approx(2 ** 0.2 - 1) and got[2025].cagr_1y is None and got[2023].cagr_3y is None
    roe = periods.returns_on_average(spark.createDataFrame([("A", 2025, 95.0)], "ticker string, year int, value double"), spark.createDataFrame([("A", 2024, 200.0), ("A", 2025, 260.0)], "ticker string, year int, value double"))
    assert roe.first()["return"] == pytest.approx(95 / 230)


REPORTS = "local_path string, source_id string, issuer_code string, period_end date, year int, quarter int, consolidated int, audited int, source_publish_date timestamp, parsed_at timestamp"


def test_preferred_report_order(spark):
    d, t = dt.date(2025, 3, 31), dt.datetime
    rows = [("new", "1", "A", d, 2025, 1, 0, 1, t(2025, 6, 1), t(2025, 6, 1)), ("old", "2", "A", d, 2025, 1, 1, 0, t(2025, 5, 1), t(2025, 5, 1)), ("x", "3", "B", None, 2025, None, None, None, None, None), ("y", "4", "B", None, 2025, None, None, None, t(2025, 1, 1), None)]
    df = spark.createDataFrame(rows, REPORTS)
    got = {r.issuer: (r.local_path, r.period_candidates, r.period_key) for r in ranking.preferred_reports(df).collect()}
    assert got == {"A": ("old", 2, "2025-03-31"), "B": ("y", 2, "2025-FY")}
    assert sorted(r.local_path for r in ranking.candidate_reports(df).collect()) == ["old", "y"]
    cov = {(r.issuer, r.year): r for r in ranking.coverage(df).collect()}
    assert cov["A", 2025].q1 == "old" and cov["B", 2025].fy == "y" and cov["A", 2025].fy is None
    assert ranking.preferred_reports(df.limit(0)).count() == 0


def test_statement_rules(spark):
    v = spark.createDataFrame(
        [("a", 1, "HEAD A", 1.0, 10), ("a", 2, "Banks", 200.0, 12), ("a", 3, "HEAD B", 1.0, 20), ("a", 2, "Banks", 50.0, 22), ("b", 1, "HEAD A", None, 5), ("b", 2, "Banks", 1.0, 6), ("b", 2, "Banks", 2.0, 7), ("c", 2, "Banks", 4.0, 1)],
        "local_path string, adp_code int, label string, value double, source_row int",
    )
    got = {r.local_path: (r.value, r["items"]) for r in S.section_lookup(v, F.col("label") == "HEAD A", F.col("label") == "Banks", F.col("label").startswith("HEAD")).collect()}
    assert got == {"a": (200.0, 1), "b": (None, 2), "c": (None, 0)}
    look = {r.local_path: r.x for r in S.label_lookup(v, {"x": ("banks",)}, {"x": 1}).collect()}
    assert look == {"a": 1.0, "b": None, "c": 4.0}


def test_translations(spark):
    e = spark.createDataFrame([("a:1", "b:1"), ("a:1", "b:2"), ("b:1", "c:1"), ("b:2", "c:1"), ("c:1", "c:2"), ("z:1", "z:2")], "src string, dst string")
    s = spark.createDataFrame([("a:1",), ("z:1",), ("c:1",)], "start string")
    got = sorted((r.start, r.path, r.hops) for r in G.translations(e, s, "c").collect())
    assert got == [("a:1", ["a:1", "b:1", "c:1"], 2), ("a:1", ["a:1", "b:2", "c:1"], 2), ("c:1", ["c:1", "c:2"], 1), ("z:1", None, None)]
    back = G.translations(e, spark.createDataFrame([("c:2",)], "start string"), "a").collect()
    assert {tuple(r.path) for r in back} == {("c:2", "c:1", "b:1", "a:1"), ("c:2", "c:1", "b:2", "a:1")}


def test_shapes_closure_and_parents(spark):
    e = spark.createDataFrame([("1000", "2000"), ("1000", "2001"), ("1001", "2002"), ("1002", "2002"), ("1003", "2003")], "src string, dst string")
    assert {(r.src, r["shape"]) for r in G.mapping_shape(e).collect()} == {("1000", "one_to_many"), ("1001", "many_to_one"), ("1002", "many_to_one"), ("1003", "one_to_one")}
    with pytest.raises(ValueError, match="cycle"):
        G.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), 5)
    c = spark.createDataFrame([("n", i, code) for i, code in enumerate(["A", "01", "01.1", "02", "B", "03", "03.1", "03.11", "x"])], "scheme string, pos int, code string").withColumn("level", G.code_level(F.col("code")))
    assert {r.code: r.parent for r in G.fill_parents(c, ["scheme"], "pos", "level", "code").collect()} == {"A": None, "01": "A", "01.1": "01", "02": "A", "B": None, "03": "B", "03.1": "03", "03.11": "03.1", "x": None}


@pytest.mark.parametrize("codes", [["A", "01", "B", "01.1"], ["A", "01", "02.1"], ["01"]])
def test_parents_that_do_not_fit_fail(spark, codes):
    c = spark.createDataFrame([("n", i, code) for i, code in enumerate(codes)], "scheme string, pos int, code string").withColumn("level", G.code_level(F.col("code")))
    with pytest.raises(Exception, match="no parent that fits"):
        G.fill_parents(c, ["scheme"], "pos", "level", "code").collect()


def test_detours_are_never_open(spark):
    n = 400
    e = spark.createDataFrame([(f"s:{i}", "n:1") for i in range(n)] + [("n:1", "r:1"), ("r:1", "w:1")], "src string, dst string")
    s = e.filter("dst = 'n:1'").select(F.col("src").alias("start"))
    assert {(r.hops, len(r.path)) for r in G.translations(e, s, "w").collect()} == {(3, 4)}
    assert {r.hops for r in G.translations(e, s, "w", 2).collect()} == {None}


def test_business_bands(spark):
    rows = [(0.36, 0.35, 0.0, "STRONG"), (0.56, 0.1, 0.4, "STRONG"), (0.9, 0.0, 0.0, "WEAK"), (0.31, 0.0, 0.3, "MODERATE"), (0.2, 0.2, 0.0, "MODERATE"), (0.11, 0.0, 0.1, "WEAK"), (0.08, 0.08, 0.0, "WEAK"), (0.12, 0.0, 0.05, "WEAK"), (0.11, 0.05, 0.05, "REJECTED"), (0.0, 0.0, 0.0, "REJECTED")]
    d = spark.createDataFrame(rows, "score double, exact double, same_group double, want string")
    assert d.withColumn("got", similarity.business_band(F.col("score"), F.col("exact"), F.col("same_group"))).filter("got <> want").collect() == []


def test_names_as_published(spark):
    d = spark.createDataFrame([("Đuro d.d.", "uro d d"), ("–", "x"), ("A", None), ("Kraš", "Kras"), ("abcd", "bcde"), ("abcd", "bcde")], "a string, b string")
    got = {(r.a, r.b): r.similarity for r in similarity.name_similarities(d, "a", "b").collect()}
    assert got == {("Đuro d.d.", "uro d d"): 1.0, ("–", "x"): 0.0, ("A", None): None, ("Kraš", "Kras"): 1.0, ("abcd", "bcde"): 0.75}
    assert similarity.name_similarities(d.limit(0), "a", "b").count() == 0


def test_series_golden(spark):
    df = spark.createDataFrame([("s", 2023, 100.0), ("s", 2024, 120.0), ("s", 2025, 180.0), ("g", 2020, 1.0), ("g", 2022, 1.0), ("o", 2020, 1.0)], "k string, year int, value double")
    yoy = {(r.k, r.year): r.yoy for r in series.series_growth(df, ["k"]).collect()}
    assert yoy["s", 2024] == 20.0 and yoy["s", 2025] == 50.0 and yoy["g", 2022] is None
    d = {r.k: r for r in series.series_direction(df, ["k"]).collect()}
    assert (d["s"].direction, d["s"].change, d["s"].cagr) == ("INCREASING", 80.0, pytest.approx((1.8**0.5 - 1) * 100, abs=1e-4))
    assert d["g"].direction == "STABLE" and d["o"].direction == "INSUFFICIENT"


def test_greedy_match(spark):
    v = spark.createDataFrame([("T", "27.11", 0.6), ("T", "28.00", 0.4), ("A", "27.11", 0.5), ("A", "27.12", 0.5), ("B", "99.00", 1.0), ("C", "28.99", 1.0)], "ticker string, code string, weight double")
    got = {r.ticker: (round(r.score, 6), r.exact, round(r.same_group, 6), r.same_division) for r in similarity.greedy_match(v, "T").collect()}
    assert got == {"A": (0.56, 0.5, 0.1, 0.0), "C": (0.14, 0.0, 0.0, 0.4)}


def test_names_and_sizes(spark):
    r = spark.createDataFrame([("KONČAR - Elektroindustrija d.d.", "koncar elektroindustrija d d", 10.0, 1000.0), (None, "x", None, 1.0)], "a string, b string, x double, y double").select(
        similarity.name_key(F.col("a")).alias("k"), similarity.name_similarity(F.col("a"), F.col("b")).alias("s"), similarity.size_similarity(F.col("x"), F.col("y")).alias("z")
    ).collect()
    assert (r[0].k, r[0].s, r[0].z) == ("koncar elektroindustrija d d", 1.0, 0.0) and r[1].s is None and r[1].z is None


def test_rules_windows_classes(spark):
    d = spark.createDataFrame([(1, "Smart GRID and cables."), (2, "grid connection"), (3, None), (4, "")], "doc_id bigint, text string")
    rules = [("R1", "n.grid", ("smart grid",), ()), ("R2", "n.both", (), ("cables", "grid"))]
    assert sorted((r.doc_id, r.rule) for r in V.match_rules(d, rules).collect()) == [(1, "R1"), (1, "R2")]
    tree = G.closure(spark.createDataFrame([("n.grid", "n"), ("n.both", "n"), ("n", None)], "node string, parent string"))
    assert sorted((r.doc_id, r.node, r.explicit) for r in V.with_ancestors(V.match_rules(d, rules), tree).collect()) == [(1, "n", False), (1, "n.both", True), (1, "n.grid", True)]
    w = spark.createDataFrame([(1, "xx Fox yy fox zz"), (2, "none"), (3, None)], "doc_id bigint, text string")
    assert sorted((r.at, r.window) for r in V.term_windows(w, ["fox"], radius=3).collect()) == [(3, "xx Fox yy"), (10, "yy fox zz")]
    assert [r.c for r in d.select(V.ordered_class(F.col("text"), [("G", ("grid",))]).alias("c")).collect()] == ["G", "G", None, "OTHER"]


def test_html(spark):
    h = "<p>Seen <b>text</b></p><script>no</script><style>x</style><table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table><table><tr><th>c</th></tr></table>"
    df = spark.createDataFrame([(h,), (None,)], "html string")
    assert [r.visible for r in V.visible_text(df, "html").collect()] == ["Seen text a in b c", None]
    r = V.html_tables(df, "html").first().tables
    assert [[list(x) for x in t] for t in r["tables"]] == [[["a in", "b"]], [["c"]]] and r["truncated"] is False
    assert V.tables_of("<table>" + "<tr><td>x</td></tr>" * 3 + "</table>", rows=2) == ([[["x"], ["x"]]], True)


def test_annuality(spark):
    d = dt.date
    f = spark.createDataFrame([("y", d(2024, 1, 1), d(2025, 1, 1), i == 0) for i in range(3)] + [("q", d(2024, 1, 1), d(2024, 4, 1), True)], "filing string, a date, b date, core boolean")
    assert {r.filing: r.annual for r in V.annuality(f, "filing", "a", "b", "core").collect()} == {"y": True, "q": False}


def test_merges_are_null_safe(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (None, "n", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, "b", None), (3, "c", "z"), (None, None, "q")], "k int, v string, w string")
    get = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert get(store.upsert_keep(old, new, ["k"], "new")) == sorted([(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (None, "n", "q")], key=str)
    assert get(store.upsert_keep(old, new, ["k"], "new", update=["w"])) == sorted([(1, "a", "x"), (2, None, "y"), (3, "c", "z"), (None, "n", "q")], key=str)
    assert get(store.replace_snapshot(old, new, ["k"])) == sorted([(1, "a", "x"), (2, "b", None), (3, "c", "z"), (None, None, "q")], key=str)
    assert relational.shared_items(spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("c", 2)], "g string, i int"), "g", "i").collect()[0] == ("a", "b", 1)
    with pytest.raises(ValueError, match="rows"):
        store.require_empty(old, "rows")


def test_swap_and_stream(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id bigint, k string, ts timestamp, v int"
    t = dt.datetime
    spark.createDataFrame([(1, "a", t(2024, 1, 1), 1), (2, "a", t(2024, 1, 2), 2), (2, "a", t(2024, 1, 2), 2)], schema).coalesce(1).write.parquet(f"{src}/1")
    for _ in range(2):
        q = stream.keep_state(stream.without_repeats(stream.event_stream(spark, f"{src}/*", schema), "id", "ts"), state, ["k"], ["ts", "id"], str(tmp_path / "cp"))
        q.awaitTermination(60)
        spark.createDataFrame([(3, "b", t(2024, 1, 1, 12), 3), (4, "a", t(2023, 12, 31, 12), 9)], schema).coalesce(1).write.mode("ignore").parquet(f"{src}/2")
    assert sorted((r.k, r.v) for r in spark.read.parquet(state).collect()) == [("a", 2), ("b", 3)]
