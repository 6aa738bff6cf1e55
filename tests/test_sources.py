import json

import pytest
import workbooks
from pyspark.sql import functions as F

from finstrata import cli
from finstrata.operators import catalogue
from finstrata.operators import statements as S
from finstrata.sources import landed, workbook


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    workbooks.half_year(d / "h1.xlsx")
    (d / "broken.xlsx").write_bytes(b"PK not a zip")
    return workbook.cells(spark, str(d)).cache()


def test_workbook_header_and_facts(book):
    bad = book.filter("error IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0].path.endswith("broken.xlsx") and "NotAWorkbook" in bad[0].error
    h = workbook.report_headers(book).collect()
    assert len(h) == 1
    r = h[0]
    assert (r.issuer_name, str(r.period_start), str(r.period_end), r.year, r.quarter, r.consolidated, r.audited) == ("Luka Primjer d.d.", "2024-01-01", "2024-06-30", 2024, 2, 1, 0)
    facts = workbook.statement_facts(book, workbook.report_headers(book)).cache()
    assert workbook.repeated_facts(facts).count() == 0
    assert facts.filter("adp_code = 2 AND statement = 'balance_sheet'").count() == 0  # the row of column numbers
    cash = facts.filter("statement = 'balance_sheet' AND adp_code = 63 AND column_name = 'current_period'").first()
    assert (cash.value, cash.unit, cash.source_row) == (31.0, "EUR", 10)
    assert facts.filter("statement = 'cash_flow_direct'").count() == 4


def test_catalogue_of_a_workbook(book):
    h = workbook.report_headers(book)
    facts = workbook.statement_facts(book, h).withColumn("fact_id", F.monotonically_increasing_id()).withColumn("parsed_at", F.lit(None).cast("timestamp"))
    got = {r.metric: r.value for r in catalogue.metrics(S.fact_values(facts), h).collect()}
    want = {"cash": 31, "gross_financial_debt_ex_other": 120, "net_debt_ex_other": 89, "sales_revenue_ytd": 180, "ebit_ytd": 30, "ebitda_simple_ytd": 45, "free_cash_flow_ytd": 17}
    want |= {"net_debt_to_ebitda_run_rate": 89 / 90, "interest_coverage_ebit": 5, "roe_run_rate": 2 * 18 / ((150 - 12 + 140 - 10) / 2)}
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert got["md_ebit_ytd"] is None


def test_parsing_stops_at_facts_stated_twice(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    workbooks.half_year(tmp_path / "in" / "h1.xlsx")
    assert cli.main(["parse", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).filter("statement = 'cash_flow_direct'").count() == 4
    monkeypatch.setitem(workbooks.PORT, "CF_I", [(20, "From operations", 0, 0), (20, "From operations", 1, 1)])
    (tmp_path / "in2").mkdir()
    workbooks.half_year(tmp_path / "in2" / "h2.xlsx")
    with pytest.raises(ValueError, match="states twice"):
        cli.main(["parse", str(tmp_path / "in2"), str(tmp_path / "out2")])
    assert not (tmp_path / "out2").exists()


def test_feed_items(spark):
    items = [{"id": 7, "issuerCode": "AAA", "publishDate": "2025-01-02", "files": [{"u": "/x/a.XLSX?v=1"}, {"u": "https://h.example/b.pdf"}, {"u": "https://h.example/b.pdf"}, {"u": "note"}]}, {"title": "no id", "b": 1}, 3]
    df = spark.createDataFrame([(json.dumps({"type": "reports", "items": items}),), ("{broken",), (None,)], "payload string")
    rows = {r.title or r.issuer_code: r for r in landed.feed_items(df, "https://h.example/").collect()}
    assert set(rows) == {"AAA", "no id"}
    assert rows["AAA"].document_urls == ["https://h.example/x/a.XLSX?v=1", "https://h.example/b.pdf"] and rows["AAA"].source_id == "7"
    assert rows["no id"].source_id == landed.canonical_id("reports", '{"b": 1, "title": "no id"}')
    assert landed.documents(landed.feed_items(df, "https://h.example/")).count() == 2


def test_directory_and_instrument(spark):
    html = "<table><tr><th>Symbol</th></tr><tr><td>AAA</td><td>HRAAA0RA0001</td><td>Aaa d.d.</td><td>C</td><td>2,572,119</td><td>-</td><td>2001-01-01</td><td></td></tr><tr><td>aaa</td><td>HRAAA0PA0002</td><td>Aaa</td><td>C</td><td>5</td><td>1</td><td>2001-01-01</td><td>2010-01-01</td></tr></table>"
    rows = landed.directory_rows(spark.createDataFrame([(html,), (None,)], "html string"))
    assert sorted((r.ticker, r.isin, r.listed_quantity, r.delisting_date) for r in rows.collect()) == [("AAA", "HRAAA0PA0002", 5, "2010-01-01"), ("AAA", "HRAAA0RA0001", 2572119, None)]
    assert landed.unique_active(rows).collect()[0].isin == "HRAAA0RA0001"
    page = "<p>Listed Quantity <b>2,572,119</b></p><script>x</script> Market Cap 2,597.84 mil. EUR"
    r = landed.instrument_pages(spark.createDataFrame([(page,)], "html string")).first()
    assert (r.listed_quantity, r.market_cap_eur) == (2572119, pytest.approx(2597.84e6))


def test_xbrl_registry_filings_bindings(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"facts": {"f1": {"value": "5", "dimensions": {"concept": "ifrs:Revenue", "period": "2024-01-01T00:00:00/2025-01-01T00:00:00", "unit": "EUR", "segment": "x:A"}}}}))
    r = landed.xbrl_facts(spark, str(tmp_path / "f.json")).first()
    assert (r.concept, str(r.period_start), str(r.period_end), r.dimensions) == ("ifrs:Revenue", "2024-01-01", "2025-01-01", {"segment": "x:A"})
    one = {"id": "abc", "attributes": {"lei": "l1", "entity": {"legalName": {"name": "N"}, "legalAddress": {"country": "hr", "city": "Z"}, "status": "ACTIVE"}, "registration": {"status": "ISSUED"}}}
    df = spark.createDataFrame([(json.dumps({"data": [one, one]}),), (json.dumps({"data": one}),), ("x",)], "payload string")
    assert [(r.lei, r.country) for r in landed.registry_records(df).collect()] == [("L1", "HR")] * 3
    fl = {"data": [{"id": "1", "attributes": {"period_end": "2024-12-31", "error_count": 0}, "relationships": {"entity": {"data": {"id": "e"}}}}], "included": [{"id": "e", "attributes": {"identifier": "LEI", "name": "N"}}]}
    assert landed.filings(spark.createDataFrame([(json.dumps(fl),)], "payload string")).first().entity_id == "LEI"
    b = {"results": {"bindings": [{"code": {"type": "literal", "value": "01"}, "label": {"type": "literal", "value": "Crops", "xml:lang": "en"}}]}}
    assert landed.bindings(spark.createDataFrame([(json.dumps(b),)], "payload string"), ("code", "label")).first() == ("01", "Crops", "en")


def test_codelist_and_urls(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("A\tFarming\n01\tCrops\n")
    assert landed.codelist_tsv(spark, str(tmp_path / "c.tsv")).count() == 2
    (tmp_path / "d.tsv").write_text("A\tFarming\nA\tAgain\nB no tab\n")
    with pytest.raises(ValueError, match="bad lines"):
        landed.codelist_tsv(spark, str(tmp_path / "d.tsv"))
    u = spark.createDataFrame([("https://ok.example/a-HR.zip",), ("http://ok.example/a.zip",), ("https://u@ok.example/a_en.json?x=1",), ("https://other.example/",), (None,)], "u string")
    got = u.select(landed.url_language(F.col("u")).alias("l"), landed.safe_url(F.col("u"), ("ok.example",)).alias("s")).collect()
    assert [r.l for r in got] == ["hr", None, "en", None, None]
    assert [r.s is not None for r in got] == [True, False, False, False, False]


def test_correspondence(spark, tmp_path):
    rows = {(1, 1): "ISIC4code", (1, 3): "ISIC5code", (2, 1): "Class", (3, 1): "1000", (3, 3): "2000", (3, 5): "split", (3, 6): "note", (4, 1): "1000", (4, 3): "2001", (5, 1): "1000", (5, 3): "2001"}
    workbooks.write(tmp_path / "x.xlsx", {"Index": {(1, 1): "see"}, "Table": rows})
    got = sorted((r.from_code, r.to_code, r.change) for r in landed.correspondence(workbook.cells(spark, str(tmp_path))).collect())
    assert got == [("1000", "2000", "split"), ("1000", "2001", None)]


def test_employee_counts(spark, tmp_path):
    notes = {(1, 1): "Prosječan broj zaposlenih (Grupa)", (1, 4): "5.610", (2, 1): "Broj zaposlenih na kraju razdoblja u društvu bio je 120 u 2024.", (3, 1): "Trošak zaposlenih", (3, 9): 999, (5, 1): "Average number of employees", (7, 1): 77, (9, 1): "Average number of employees", (9, 3): 2.5}
    workbooks.write(tmp_path / "n.xlsx", {"Bilješke": notes, "Bilanca": {(1, 1): "Number of employees", (1, 2): 5}})
    c = workbook.cells(spark, str(tmp_path)).cache()
    got = {(r.measure, r.scope): (r.value, r.source_row) for r in workbook.employee_counts(c, workbook.report_headers(c)).collect()}
    assert got == {("average", "group"): (5610.0, 1), ("period_end", "company"): (120.0, 2), ("average", "unspecified"): (77.0, 5)}


def test_issuer_pages(spark):
    lei = "A" * 18 + "12"
    html = f"<a>Home</a><h1>Aaa d.d.</h1><a>News</a><p>Home Member State</p><b>Croatia</b><p>LEI {lei}</p><p>{lei}</p>"
    two = html + f"<p>{'B' * 18}34</p>"
    rows = landed.issuer_pages(spark.createDataFrame([(html,), (two,), (None,)], "html string")).collect()
    assert [(r.lei, r.leis, r.home_state, r.issuer_name) for r in rows] == [(lei, 1, "Croatia", "Aaa d.d."), (None, 2, "Croatia", "Aaa d.d."), (None, 0, None, None)]


def test_reported_texts_and_first_annual(spark):
    from finstrata.operators import evidence as V

    f = spark.createDataFrame([("p", "1", "c:Activity", "en", "<p>Makes <b>cables</b></p>"), ("p", "2", "c:Other", "en", "x" * 50), ("p", "3", "c:Number", None, "5"), ("p", "4", "c:Z", "hr", " ")], "path string, fact string, concept string, language string, value string")
    got = {r.fact: (r["class"], r.text, r.truncated) for r in V.reported_texts(f, [("ACTIVITY", ("activity",))], longest=20).collect()}
    assert got == {"1": ("ACTIVITY", "Makes cables", False), "2": ("OTHER", "x" * 20, True)}
    fl = spark.createDataFrame([("e", "a", "2025-06-30", False), ("e", "b", "2024-12-31", True), ("e", "c", "2023-12-31", True), ("g", "d", "2024-12-31", False)], "entity string, filing_id string, period_end string, annual boolean")
    assert [(r.entity, r.filing_id, r.passed_over) for r in V.first_annual(fl, "entity", "period_end", "annual").collect()] == [("e", "b", 1)]
