import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from finstrata.operators import entities as N
from finstrata.operators import profiles as P

REC = "record int, lei string, isin string, exchange string, ticker string, name string, country string"
LEI = "A" * 18 + "12"


def test_register_merges_and_refuses(spark):
    ents = spark.createDataFrame([("ISIN:HR0000000001", "Old", "HR")], "entity_id string, name string, country string")
    known = spark.createDataFrame([("ISIN:HR0000000001", "ISIN", "HR0000000001")], "entity_id string, scheme string, value string")
    recs = spark.createDataFrame([(1, LEI, "hr0000000001", None, None, "New", None), (2, None, None, "xzag", "abc", None, "HR"), (3, None, "bad", None, None, "Only a name", None), (4, None, None, None, None, None, None)], REC)
    e, k = N.register(recs, ents, known)
    got = {r.entity_id: (r.name, r.country) for r in e.collect()}
    assert got["ISIN:HR0000000001"] == ("New", "HR") and got["XZAG:ABC"] == (None, "HR") and len(got) == 3
    assert {(r.scheme, r.value) for r in k.collect()} == {("ISIN", "HR0000000001"), ("LEI", LEI), ("TICKER", "XZAG:ABC")}
    assert {r.entity_id: len(r.identifiers) for r in N.nested(e, k).collect()}["ISIN:HR0000000001"] == 2
    two = known.unionByName(spark.createDataFrame([("LEI:x", "LEI", LEI)], known.schema))
    with pytest.raises(ValueError, match="several entities"):
        N.register(recs, ents, two)


def test_placeholders_are_repaired(spark):
    items = spark.createDataFrame([("unknown-1", "v"), ("9", "v"), ("unknown-2", "v")], "source_id string, variant string")
    docs = spark.createDataFrame([("unknown-1", "v", "a"), ("9", "v", "a"), ("unknown-2", "v", "b")], "source_id string, variant string, url string")
    i, d = N.repair_placeholder_ids(items, docs)
    assert sorted(r.source_id for r in i.collect()) == ["9", "unknown-2"] and sorted(map(tuple, d.collect())) == [("9", "v", "a"), ("unknown-2", "v", "b")]


def test_profiles(spark):
    one = {"profile": {"ticker": "aaa", "profile_date": "2025-01-01", "description": "d"}, "segments": [{"segment_key": "s1", "name": "B", "share": 0.2}, {"segment_key": "s2", "name": "A", "share": 0.7}, {"segment_key": "s3", "name": "C"}], "activities": [{"activity_key": "x", "name": "", "share": 2.0}]}
    df = spark.createDataFrame([(json.dumps(one),), ("{",), (json.dumps({"profile": {"ticker": "b"}}),), (json.dumps({"profile": {"ticker": "AAA", "profile_date": "2026-01-01"}}),)], "bundle string")
    t = P.children(df)
    assert t["profiles"].count() == 2
    n = P.nested(t).filter("profile_date = '2025-01-01'").first()
    assert [x["name"] for x in n.segments] == ["A", "B", "C"]
    assert P.as_of(t["profiles"], F.lit(dt.date(2025, 6, 1))).first().profile_date == dt.date(2025, 1, 1)
    g = {str(r.profile_date): (r.parts, len(r.missing)) for r in P.gaps(t).collect()}
    assert g == {"2025-01-01": (2, 4), "2026-01-01": (0, 6)}
    from finstrata.operators.store import violations

    assert sorted(r.rule for r in violations(t["activities"], P.share_rules(), ["activity_key"]).collect()) == ["no name", "share out of range"]
