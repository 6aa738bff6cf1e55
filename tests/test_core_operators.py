import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finstrata.functions import exprs as E
from finstrata.functions.text import alnum_key, fold
from finstrata.operators import drift, history, relational, units, wide
from finstrata.operators.ordered import neighbours
from finstrata.plans import corpus

T = dt.datetime


# --- p1 -----------------------------------------------------------------------------------

LANDING = "file_id bigint, source string, produced_at timestamp, loaded_at timestamp, line_no int, payload string"


def _landing(spark, files):
    """files: (source, file_id, day, [payload])"""
    rows = [(f, s, T(2026, 1, 1) + dt.timedelta(days=d), None, i, p if p is None or isinstance(p, str) else json.dumps(p)) for s, f, d, lines in files for i, p in enumerate(lines)]
    return spark.createDataFrame(rows, LANDING)


def _rec(n, **more):
    return {"local_path": f"p{n}", "statement": "s", "adp_code": n, "column_name": "c", **more}


def _changes(spark, files):
    return sorted((r.file_id, r.change_kind, r.field_name) for r in drift.drift(_landing(spark, files)).changes().collect())


def test_drift_kinds(spark):
    files = [
        ("a", 1, 0, [_rec(1, unit="EUR", row=5), _rec(2, unit=None, row=6)]),
        ("a", 2, 1, [_rec(1, measure="EUR", row="5"), _rec(2, measure=None, row="6"), '{"cut": ']),
        ("a", 3, 2, [_rec(1, measure=None, row=None, note=True)]),
        ("a", 4, 3, [_rec(1, measure=["EUR"], src={"row": 7})]),
        ("b", 9, 0, [_rec(1, x=1)]),
    ]
    assert _changes(spark, files) == [(2, "renamed", "measure"), (2, "retyped", "row"), (3, "added", "note"), (4, "added", "src.row"), (4, "removed", "note"), (4, "removed", "row"), (4, "retyped", "measure")]


def test_drift_type_survives_null_renames(spark):
    files = [("a", 1, 0, [_rec(1, q=1), _rec(2, q=2)]), ("a", 2, 1, [_rec(2, q=None), _rec(3, q=3)]), ("a", 3, 2, [_rec(3, w=3), _rec(4, w=None)]), ("a", 4, 3, [_rec(3, w="3")])]
    assert _changes(spark, files) == [(3, "renamed", "w"), (4, "retyped", "w")]


def test_drift_empty_and_damaged(spark):
    assert _changes(spark, []) == []
    assert _changes(spark, [(None, 1, 0, [None, "", "[1]", '"x"', '{"a":1} rest', '{"a":NaN}']), (None, 2, 1, ['{"a":1,"b":{}}'] * 3)]) == [(2, "added", "a")]


def test_drift_ignores_extra_columns_and_agrees_with_its_table(spark):
    df = _landing(spark, [("a", 1, 0, [_rec(1, row=5, unit="EUR")]), ("a", 2, 1, [_rec(1, redak="R5", unit=["EUR"]), _rec(2, redak=7)])]).withColumn("path", F.lit("clash")).withColumn("type", F.lit("clash"))
    facts = drift.consistent_facts(df)
    assert sorted((r.file_id, r.source_row, r.unit) for r in facts.collect()) == [(1, 5, "EUR"), (2, 5, "EUR"), (2, 7, None)]


def test_facts_join_the_words_of_arrays(spark):
    lines = [_rec(1, label=["Shares", "issued"], unit=["EUR"], source_sheet=["P&L", None, "2"]), _rec(2, label="Shares", source_row=[119, 119]), _rec(3, label=[])]
    got = {r.adp_code: (r.label, r.unit, r.source_sheet, r.source_row) for r in drift.consistent_facts(_landing(spark, [("a", 1, 0, lines)])).collect()}
    assert got == {1: ("Shares issued", "EUR", "P&L 2", None), 2: ("Shares", None, None, 119), 3: (None, None, None, None)}


def test_facts_read_amounts_as_written(spark, sf):
    written = {1: "188.578,29", 2: "128,94", 3: "1.234.567", 4: "-2,5", 5: "1e3", 6: ["7,5"], 7: [1, 2], 8: 9, 9: 9.5, 10: "n/a", 11: True, 12: None}
    rows = drift.consistent_facts(_landing(spark, [("a", 1, 0, [_rec(n, value=v) for n, v in written.items()])])).collect()
    assert {r.adp_code: r.value for r in rows} == {1: 188578.29, 2: 128.94, 3: 1234567.0, 4: -2.5, 5: 1000.0, 6: 7.5, 7: None, 8: 9.0, 9: 9.5, 10: None, 11: None, 12: None}
    assert {r.adp_code: r.branches["value"].text for r in rows if r.value is None} == {7: "[1, 2]", 10: "n/a", 11: "true", 12: None}
    stated = drift.consistent_facts(spark.read.parquet(f"{sf}/facts_landing.parquet")).select("value", F.col("branches")["value"].alias("b")).filter("b.text IS NOT NULL").collect()
    assert [r.value for r in stated] == [float(r.b.text.replace(".", "").replace(",", ".") if r.b.type == "string" else r.b.text) for r in stated]


def test_facts_keep_branches_and_later_names(spark, tmp_path):
    files = [
        ("a", 1, 0, [_rec(1, lineLabel="Sales", zz="RDG", page=3, value="n/a")]),
        ("a", 2, 1, [_rec(1, naziv="Sales", sheet="RDG", page="3", value=2), _rec(2, naziv="Costs", sheet="RDG", value=1.5)]),
        ("b", 3, 0, [_rec(1, label=None, Label="Own", naziv="Other")]),
    ]
    _landing(spark, files).write.parquet(f"{tmp_path}/facts_landing.parquet")
    rows = {(r.file_id, r.adp_code): r for r in corpus.p1_facts(spark, str(tmp_path)).collect()}
    assert {k: (r.label, r.source_sheet, r.value) for k, r in rows.items()} == {(1, 1): ("Sales", "RDG", None), (2, 1): ("Sales", "RDG", 2.0), (2, 2): ("Costs", "RDG", 1.5), (3, 1): ("Other", None, None)}
    assert rows[1, 1].branches["value"] == ("string", "n/a")
    assert [rows[k, 1].extras["page"] for k in (1, 2)] == [("integer", "3"), ("string", "3")]
    assert {k: tuple(v) for k, v in rows[3, 1].extras.items()} == {"Label": ("string", "Own"), f"label{drift.SEP}label": (None, None)}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
@settings(max_examples=100, deadline=None)
def test_flatten_keeps_values(v):
    got = drift.flatten(json.dumps({"k": v}))
    if not isinstance(v, dict):
        assert got["k"][0] == {type(None): None, bool: "boolean", int: "integer", float: "decimal", str: "string", list: "array"}[type(v)]
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            assert float(got["k"][1]) == float(v)


# --- p2 -----------------------------------------------------------------------------------

SECURITIES = "snapshot_id bigint, ticker string, sector string, listed_quantity bigint, delisting_date string, updated_at timestamp, ingested_at timestamp"


def _brute_versions(rows):
    last = {}
    for sid, t, sec, q, d, up, ing in rows:
        if t and t.strip() and up:
            k = (t.strip().upper(), up)
            if k not in last or (ing, sid) > last[k][0]:
                last[k] = ((ing, sid), sec, q, d)
    out, state = [], {}
    for (t, up), (_, sec, q, d) in sorted(last.items()):
        now = {"s": sec.strip().lower().replace("š", "s") if sec and sec.strip() else None, "q": q, "d": d.strip() if d and d.strip() not in ("", "-") else "-"}
        old = state.get(t)
        if old is None or any(v is not None and old[k] is not None and v != old[k] for k, v in now.items()):
            out.append((t, up))
        state[t] = {k: v if v is not None else (old or {}).get(k) for k, v in now.items()}
    return sorted(out)


def test_history_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", " A", "b", "HOT", "HOT", None, " "]), r.choice([None, "Škola", "skola ", "Mine", ""]), r.choice([None, 1, 2]), r.choice([None, "", "-", "2020-01-02", "3.1.2021."]), T(2020, 1, 1) + dt.timedelta(days=r.randrange(700)), T(2022, 1, 1) + dt.timedelta(days=r.randrange(50))) for i in range(600)]
    rows = [x[:5] + x[5:] for x in rows]
    df = spark.createDataFrame(rows + rows[:20], SECURITIES).withColumn("name", F.lit("x")).withColumn("key", F.lit("clash"))
    got = sorted((x.ticker, x.valid_from) for x in history.history(df).select("ticker", F.col("valid_from")).collect())
    assert got == _brute_versions(rows)


def test_history_values_and_intervals(spark):
    rows = [(1, "A", None, 5, None, T(2020, 1, 1), T(2020, 1, 1)), (2, "A", "Mine", None, "01/02/2021", T(2020, 3, 1), T(2020, 3, 1)), (3, "A", "MINE", 5, "2021-02-01", T(2020, 4, 1), T(2020, 4, 1)), (4, "A", "Mine", 6, "1.2.2021.", T(2020, 5, 1), T(2020, 5, 1))]
    got = [tuple(map(str, r)) for r in history.history(spark.createDataFrame(rows, SECURITIES)).orderBy("valid_from").collect()]
    assert got == [
        ("A", "2020-01-01 00:00:00", "2020-03-01 00:00:00", "None", "5", "None"), ("A", "2020-03-01 00:00:00", "2020-05-01 00:00:00", "Mine", "5", "2021-02-01"), ("A", "2020-05-01 00:00:00", "None", "Mine", "6", "2021-02-01"),
    ]
    assert history.history(spark.createDataFrame([], SECURITIES)).count() == 0


def test_neighbours_look_past_chunks_and_nulls(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 5, None), ("k", 25, None), ("k", 31, "b"), (None, 2, "z"), (None, 90, None)], "k string, t int, v string")
    back = {(r.k, r.t): r.prev_v for r in neighbours(df, ["k"], ["t"], F.floor(F.col("t") / 10), ["v"]).collect()}
    assert back == {("k", 1): None, ("k", 5): "a", ("k", 25): "a", ("k", 31): "a", (None, 2): None, (None, 90): "z"}
    ahead = {(r.k, r.t): r.next_v for r in neighbours(df, ["k"], ["t"], F.floor(F.col("t") / 10), ["v"], ahead=True).collect()}
    assert ahead == {("k", 1): "b", ("k", 5): "b", ("k", 25): "b", ("k", 31): None, (None, 2): None, (None, 90): None}


# --- p3 -----------------------------------------------------------------------------------


def test_compositions_find_shortest_and_reject_contradictions():
    e = units.Edge
    ways = units.compositions([e("C", "K", 1, 273.15), e("F", "C", 5 / 9, -160 / 9), e("K", "R", 1.8)], "K")
    a, b, n = ways["F"]
    assert n == 2 and a * 212 + b == pytest.approx(373.15) and ways["R"][0] == pytest.approx(1 / 1.8)
    with pytest.raises(units.InconsistentUnits):
        units.compositions([e("a", "b", 2), e("b", "c", 3), e("a", "c", 7)], "c")
    with pytest.raises(units.InconsistentUnits):
        units.compositions([e("a", "b", 0)], "b")
    with pytest.raises(units.InconsistentUnits):  # a part that doesn't reach the target
        units.compositions([e("x", "y", 2), e("y", "x", 2)], "c")


FACTS = "fact_id bigint, local_path string, statement string, label string, value double, unit string"
REPORTS = "local_path string, currency string, scale double, period_end date, year int"


def test_units_most_specific_wins(spark):
    facts = [
        (1, "p", "bs", "Cash (u tisućama kuna)", 2.0, "EUR"), (2, "p", "bs", "Loans of eurozone banks, over a year", 3.0, "kEUR"), (3, "p", "bs", None, 5.0, "-"), (4, "q", "bs", "x", 7.0, None), (5, "p", "general_data", "x", 1.0, "EUR"),
        (6, "p", "bs", "x", None, "EUR"), (7, "x/2022/Q4/1", "bs", "x - mil.", 1.0, "%"), (8, "none", "bs", "y", 1.0, ""), (9, "p", "bs", "z", -1.5, "US$m"), (9, "p", "bs", "z", -1.5, "US$m"), (10, "p", None, "z", float("nan"), "EUR"),
    ]
    reports = [("p", "Kuna", 1000.0, dt.date(2023, 3, 31), 2023), ("p", "Kuna", 1000.0, dt.date(2023, 3, 31), 2023), ("q", None, None, dt.date(2022, 12, 31), None)]
    rates = spark.createDataFrame([("EUR", 1.0), ("HRK", 7.5345), ("USD", 1.25)], "currency string, units_per_eur double")
    out = units.to_base(spark.createDataFrame(facts, FACTS).withColumn("currency", F.lit("clash")), spark.createDataFrame(reports, REPORTS), rates)
    got = sorted((r.fact_id, r.currency, r.scale, round(r.amount, 2)) for r in out.collect())
    assert got == [
        (1, "HRK", 1000.0, 265.45), (2, "EUR", 1000.0, 3000.0), (3, "HRK", 1000.0, 663.61), (4, "HRK", 1.0, 0.93), (7, "HRK", 1e6, 132722.81), (8, "EUR", 1.0, 1.0), (9, "USD", 1e6, -1.2e6), (9, "USD", 1e6, -1.2e6),
    ]
    assert units.to_base(spark.createDataFrame([], FACTS), spark.createDataFrame([], REPORTS), rates).count() == 0


def test_long_texts_are_no_units(spark):
    long = [(1, "p", "bs", "x" + ", EUR" * 50_000, 1.0, "EUR " * 50_000), (2, "p", "bs", "x" + " " * 200_000 + "(tis.)", 1.0, "9" * 200_000), (3, "p", "bs", "(" * 100_000, 1.0, None)]
    rates = spark.createDataFrame([("EUR", 1.0), ("HRK", 7.5345)], "currency string, units_per_eur double")
    out = units.to_base(spark.createDataFrame(long, FACTS), spark.createDataFrame([("p", "EUR" * 50_000, 1.0, None, 2024)], REPORTS), rates)
    assert sorted((r.fact_id, r.currency, r.scale) for r in out.collect()) == [(1, "EUR", 1.0), (2, "EUR", 1000.0), (3, "EUR", 1.0)]


# --- p4 -----------------------------------------------------------------------------------


def test_wide_resolves_types_and_keeps_failures(spark):
    rows = [("a", "n", "1", T(2020, 1, 1), 1), ("a", "n", "2", T(2021, 1, 1), 2), ("a", "n", None, T(2022, 1, 1), 3), ("a", "d", "2020-02-30", None, 4), ("b", "n", "x", None, 5), ("b", "rest", "9", None, 6), (None, "n", "1", None, 7), ("c", None, "1", None, 8)]
    df = spark.createDataFrame(rows, "local_path string, attribute string, value string, parsed_at timestamp, tie bigint")
    w = wide.to_wide(wide.resolve(df), ["n", "d"], {"n": "bigint", "d": "date"}).orderBy("local_path").collect()
    assert [(r.local_path, r.n, r.d, r.cast_failures, r.other) for r in w] == [("a", 2, None, {"d": "2020-02-30"}, {}), ("b", None, None, {"n": "x"}, {"rest": "9"})]
    with pytest.raises(ValueError, match="types"):
        wide.to_wide(wide.resolve(df), ["n"], {"n": "money"})


def test_wide_cells_are_the_pairs(spark, sf):
    facts, metrics = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("facts", "metrics"))
    resolved = wide.resolve(wide.pairs(facts, metrics))
    names = wide.known_attributes(resolved)
    back = wide.cells(wide.to_wide(resolved, names), names)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, resolved.collect()))
    empty = wide.to_wide(resolved.limit(0), [])
    assert empty.count() == 0 and empty.columns == ["local_path", "cast_failures", "other"]


# --- expressions --------------------------------------------------------------------------


def _one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(c.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("1.234,5", 1234.5), ("1 234,5", 1234.5), ("1234.5", 1234.5), ("12,5", 12.5), ("-3", -3.0), ("1,234,5", None), ("x", None), ("", None)])
def test_european_number(spark, text, want):
    assert _one(spark, E.european_number(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("31.03.2025.", "2025-03-31"), ("2025-03-31", "2025-03-31"), ("1/2/2025", "2025-02-01"), ("31.2.2025", None), ("soon", None)])
def test_parse_date(spark, text, want):
    got = _one(spark, E.parse_date(F.col("t")), t=text)
    assert (got and str(got)) == want


@pytest.mark.parametrize(("label", "want"), [("IV. Novac u banci", "novac u banci"), ("3. Građevine AOP 12", "gra evine"), ("a) Čista dobit (ADP 5+6)", "cista dobit"), ("AOP 1", "aop 1")])
def test_label_key(spark, label, want):
    assert _one(spark, E.label_key(F.col("t")), t=label) == want


def test_scalars(spark):
    assert _one(spark, E.ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert _one(spark, E.cagr(F.col("a"), F.col("b"), 5), a=100.0, b=200.0) == pytest.approx(2 ** (1 / 5) - 1)
    assert _one(spark, E.pct_change(F.col("a"), F.col("b")), a=120.0, b=100.0) == 20.0
    assert _one(spark, E.file_kind(F.col("t")), t="https://x/y.PDF?z=1") == "pdf"
    assert _one(spark, E.isin_code(F.col("t")), t=" hr0000000001 ") == "HR0000000001"
    assert _one(spark, E.lei_code(F.col("t")), t="short") is None
    assert _one(spark, fold(F.col("t")), t="  ĐURO  Šarić ") == "duro saric"
    assert _one(spark, alnum_key(F.col("t")), t="Current-Period 1") == "currentperiod1"


def test_overlaps_of_all_items_with_both_differences(spark):
    df = spark.createDataFrame([(g, i) for g, items in {"a": "xy", "b": "xy", "c": "yz", "d": "w"}.items() for i in items] + [("a", "x"), (None, "x"), ("d", None)], "g string, i string")
    got = sorted((r.a, r.b, r.shared, "".join(r.only_a), "".join(r.only_b)) for r in relational.overlaps(df, "g", "i").collect())
    assert got == [("a", "b", 2, "", ""), ("a", "c", 1, "x", "z"), ("b", "c", 1, "x", "z")]


def test_overlaps_of_a_hot_set_are_many_tasks(spark):
    n = 1200
    items = {**{f"h{i:04}": "xy" for i in range(n)}, "a": "xyz", "z": "y", "w": "v"}
    df = spark.createDataFrame([(g, i) for g, s in items.items() for i in s], "g string, i string")
    got = relational.overlaps(df, "g", "i")
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(tasks) == n * (n - 1) // 2 + 2 * n + 1
    assert max(tasks) < 0.7 * sum(tasks)
    want = {("a", "h0007"): (2, ["z"], []), ("a", "h1100"): (2, ["z"], []), ("h0007", "h1100"): (2, [], []), ("h0007", "z"): (1, ["x"], []), ("a", "z"): (1, ["x", "z"], [])}
    assert {(r.a, r.b): (r.shared, r.only_a, r.only_b) for r in got.filter("a IN ('a', 'h0007') AND b IN ('h0007', 'h1100', 'z')").collect()} == want
    assert got.filter("a >= b").count() == 0 and got.select("a", "b").distinct().count() == sum(tasks)


def test_wide_found_keeps_a_metric_named_other(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/facts.parquet").limit(0).write.parquet(f"{tmp_path}/facts.parquet")
    spark.read.parquet(f"{sf}/metrics.parquet").limit(1).withColumns({"local_path": F.lit("p"), "metric_name": F.lit("Other"), "value": F.lit(2.0)}).write.parquet(f"{tmp_path}/metrics.parquet")
    assert [tuple(r) for r in corpus.p4_found(spark, str(tmp_path)).collect()] == [("p", "other", 2_000_000)]


def test_units_of_any_length(spark):
    fill = "in of " * 40
    rows = [("(" + fill + "000 kn)",), ("u tis. kuna" + " " * 200_000,), (", " + "kn " * 20_000,), ("(" + fill + "kn i dionice)",), ("(keurs)",), ("",), (None,)]
    d = spark.createDataFrame(rows, "t string")
    label = units.whole_unit(units.label_marker(F.col("t")))
    got = [(r.c, r.s, r.u) for r in d.select(units.stated_currency(label).alias("c"), units.stated_scale(label).alias("s"), units.whole_unit(units.unit_text(F.col("t"))).isNotNull().alias("u")).collect()]
    assert got == [("HRK", 1000, True), (None, None, True), ("HRK", None, True), (None, None, False), (None, None, False), (None, None, False), (None, None, False)]


def test_counts_with_decimals_are_failures(spark):
    rows = [("a", "n", 5.0), ("b", "n", 5.5), ("c", "x", 1.5), ("d", "n", 1e30)]
    w = wide.to_wide(spark.createDataFrame(rows, "local_path string, attribute string, value double"), ["n", "x"], {"n": "bigint"})
    assert {r.local_path: (r.n, r.x, r.cast_failures) for r in w.collect()} == {"a": (5, None, {}), "b": (None, None, {"n": "5.5"}), "c": (None, 1.5, {}), "d": (None, None, {"n": "1.0E30"})}
