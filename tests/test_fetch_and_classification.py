import io
import json
import urllib.error

import pytest

from finstrata import cli
from finstrata.sources import classification as C
from finstrata.sources import fetch


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(round(s, 3))
        self.now += s


def _fetcher(answers, **kw):
    c = Clock()
    todo = list(answers)

    def opener(url, timeout):
        a = todo.pop(0)
        if isinstance(a, Exception):
            raise a
        return io.BytesIO(a)

    return fetch.Fetcher(frozenset({"ok.example"}), opener=opener, clock=lambda: c.now, sleep=c.sleep, **kw), c


def test_fetcher_spaces_retries_and_bounds():
    f, c = _fetcher([OSError("down"), b'{"a": 1}', b"12345", b"<html>"], most=20)
    assert f.json("https://ok.example/x") == {"a": 1}
    assert f.read("https://ok.example/y") == b"12345"
    assert 1.0 in c.slept
    with pytest.raises(fetch.FetchError, match="page"):
        f.json("https://ok.example/z")
    f, _ = _fetcher([b"x" * 30], most=20)
    with pytest.raises(fetch.FetchError, match="bytes"):
        f.read("https://ok.example/x")
    f, _ = _fetcher([urllib.error.HTTPError("u", 403, "no", None, None), b"x"])
    with pytest.raises(fetch.FetchError, match="403"):
        f.read("https://ok.example/x")
    for url in ("http://ok.example/", "https://other.example/", "https://u:p@ok.example/", "https://ok.example:8080/"):
        with pytest.raises(fetch.FetchError, match="allowed"):
            f.read(url)


def test_pages_end_with_a_short_one():
    f, _ = _fetcher([json.dumps([1, 2]).encode(), json.dumps([3]).encode()])
    assert list(f.pages(lambda o: f"https://ok.example/?offset={o}", lambda a: a, 2)) == [[1, 2], [3]]


def test_landing_is_by_content(tmp_path):
    a, b = fetch.land(str(tmp_path), b"x"), fetch.land(str(tmp_path), b"x")
    assert a == b and len(list(tmp_path.iterdir())) == 1
    fetch.write_manifest(str(tmp_path / "m.json"), {"b": 1, "a": "č"})
    assert (tmp_path / "m.json").read_text().index('"a"') < (tmp_path / "m.json").read_text().index('"b"')
    assert set(fetch.ensure_layout(str(tmp_path / "w"), ("feed",))) == set(fetch.LAYOUT)


def test_scheme_checks(spark):
    items = spark.createDataFrame([("c1", "A", None), ("c2", "01", "c1"), ("c3", "01.1", "c2"), ("c3", "01.1", "c2")], "concept string, code string, parent_concept string")
    labels = spark.createDataFrame([(c, "en", "prefLabel", n) for c, n in (("c1", "Farming"), ("c2", "Crops"), ("c3", "Cereals"))] + [("c3", "hr", "prefLabel", "Žitarice")], "concept string, language string, kind string, label string")
    parts = C.accept(C.scheme(items, labels), {1: 1, 2: 1, 3: 1})
    assert {(r.code, r.parent, r.level) for r in parts["items"].collect()} == {("A", None, 1), ("01", "A", 2), ("01.1", "01", 3)}
    with pytest.raises(ValueError, match="levels"):
        C.accept(C.scheme(items, labels), {1: 1, 2: 2, 3: 1})
    bad = C.scheme(items.unionByName(spark.createDataFrame([("c4", "x9", "gone"), ("c2", "02", "c1")], items.schema)), labels)["problems"]
    assert {(r.code, r.problem) for r in bad.collect()} == {("01", "several codes"), ("x9", "unknown shape"), ("x9", "missing parent"), ("x9", "no English label")}
    assert [r.label for r in C.search(parts["items"], parts["labels"], "žitar").collect()] == ["Žitarice"]
    got = C.translate(spark.createDataFrame([("n1",), ("n2",)], "node string"), spark.createDataFrame([("n1", "exact", "01")], "node string, relation string, code string"), parts["items"], parts["labels"])
    assert {(r.node, r.label, r.mapped) for r in got.collect()} == {("n1", "Crops", True), ("n2", None, False)}
    with pytest.raises(ValueError, match="doesn't have"):
        C.translate(got.select("node"), spark.createDataFrame([("n1", "exact", "99")], "node string, relation string, code string"), parts["items"], parts["labels"])
    links = C.structural_links(spark.createDataFrame([("01.11.2",), ("02.1",), ("A",)], "code string"), spark.createDataFrame([("01.11",), ("03",)], "code string"))
    assert [tuple(r) for r in links.collect()] == [("01.11.2", "01.11")]


def test_codelists(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<s:Structure xmlns:s="u"><s:Codelist id="CL_A" agencyID="X" version="2.1"><s:Name lang="de">Liste</s:Name><s:Name lang="en">Activities</s:Name></s:Codelist><s:Codelist id="CL_B" agencyID="X" version="1.0"><s:Name lang="en">Other</s:Name></s:Codelist></s:Structure>')
    stubs = C.codelist_stubs(spark, str(tmp_path / "r.xml"), "s:Codelist")
    if stubs.filter("id IS NOT NULL").count() == 0:
        stubs = C.codelist_stubs(spark, str(tmp_path / "r.xml"))
    assert C.choose_codelist(stubs, "CL_Z", "activities", "2.1").first().id == "CL_A"
    assert C.choose_codelist(stubs, "CL_B", "activities", "2.1").first().id == "CL_B"
    assert C.choose_codelist(stubs, "CL_Z", "none", "2.1").first().id is None


def test_cli_names(capsys):
    assert cli.main(["list"]) == 0 and "ttm" in capsys.readouterr().out
    assert cli.main(["run", "no_such_query"]) == 2
