"""Text evidence: rule matching on a taxonomy, windows around terms, classes of disclosures, annual filings."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstrata.functions.text import fold
from finstrata.session import share_code


def spaced(c: Column) -> Column:
    """` word word `: folded words between blanks, so that a phrase is a plain substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def match_rules(docs: DataFrame, rules: Sequence[tuple[str, str, tuple[str, ...], tuple[str, ...]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, node) where a text holds one of a rule's aliases, or all of its required terms.

    rules: id, node, aliases, required. They are few and constant, so they go into the plan as literals and
    the match is a map-side expression: no join at all.
    """
    t = spaced(F.col(text))
    d = docs.filter(F.col(text).isNotNull()).select(key, t.alias("t"))
    has = lambda p: F.contains(F.col("t"), F.lit(f" {p} "))
    hits = []
    for rule, node, aliases, required in rules:
        ok = F.lit(False)
        for a in aliases:
            ok = ok | has(a)
        if required:
            every = F.lit(True)
            for r in required:
                every = every & has(r)
            ok = ok | every
        hits.append(F.when(ok, F.struct(F.lit(rule).alias("rule"), F.lit(node).alias("node"))))
    return d.select(key, F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def with_ancestors(matches: DataFrame, closure: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node, explicit): the matched nodes and those of their ancestors that aren't matched themselves."""
    m = matches.select(key, "node").distinct()
    up = m.join(closure.filter("depth > 0").select("node", "ancestor"), "node").select(key, F.col("ancestor").alias("node")).distinct()
    derived = up.join(m, [key, "node"], "left_anti")
    return m.withColumn("explicit", F.lit(True)).unionByName(derived.withColumn("explicit", F.lit(False)))


def term_windows(docs: DataFrame, terms: Sequence[str], radius: int = 500, same: int = 180, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, at, window): the text around every occurrence of each term, without windows that begin alike.

    Case aside; `at` counts from 0; of windows whose first `same` characters are equal within a text the
    first is kept. JVM only: a text is split at the term, and positions are running lengths.
    """
    d = docs.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), F.lower(F.col(text)).alias("low"))
    each = d.select(key, "t", "low", F.explode(F.array(*map(F.lit, terms))).alias("term")).filter(F.contains("low", "term"))
    parts = F.split("low", F.concat(F.lit(r"\Q"), F.col("term"), F.lit(r"\E")))
    n = F.length("term")
    ends = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + n, F.lit(0)) + F.length(x))),
    )
    at = each.select(key, "t", "term", n.alias("n"), F.explode(ends).alias("at"))
    low = F.greatest(F.lit(0), F.col("at") - radius)
    w = at.select(key, "term", "at", F.substring(F.col("t"), low + 1, F.col("at") + F.col("n") + radius - low).alias("window"))
    return w.groupBy(key, F.substring("window", 1, same).alias("head")).agg(F.min(F.struct("at", "term", "window")).alias("x")).select(key, "x.term", "x.at", "x.window")


def ordered_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]], other: str = "OTHER") -> Column:
    """The first class one of whose words the folded text holds."""
    t = fold(text)
    out = None
    for name, words in classes:
        hit = t.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(text.isNotNull(), out.otherwise(other))


def annuality(facts: DataFrame, filing: str, start: str, end: str, core: str, shortest: int = 320, longest: int = 410, least: int = 3) -> DataFrame:
    """(filing, annual_facts, core_facts, annual): a filing is annual with `least` facts over a year, one of them on a core concept.

    facts carry start (date), end (date, exclusive) and whether the concept is a core one.
    """
    year = F.datediff(end, start).between(shortest, longest)
    g = facts.groupBy(filing).agg(F.count_if(year).alias("annual_facts"), F.count_if(year & F.col(core)).alias("core_facts"))
    return g.withColumn("annual", (F.col("annual_facts") >= least) & (F.col("core_facts") >= 1))


class _Visible(HTMLParser):
    """Text outside script, style, noscript and svg."""

    HIDDEN = frozenset({"script", "style", "noscript", "svg"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.out.append(" ".join(data.split()))


def visible_text_of(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Visible()
    p.feed(html)
    p.close()
    return " ".join(p.out)


@F.pandas_udf(T.StringType())
def _visible_text(s: pd.Series) -> pd.Series:
    return s.map(visible_text_of, na_action="ignore")


def visible_text(df: DataFrame, html: str, name: str = "visible") -> DataFrame:
    """`df` with the text a reader of the HTML would see, white space squeezed; null stays null."""
    return share_code(df).withColumn(name, _visible_text(F.col(html)))


class _Tables(HTMLParser):
    """Rows of the outermost tables."""

    def __init__(self, tables: int, rows: int, cells: int, chars: int) -> None:
        super().__init__(convert_charrefs=True)
        self.most = (tables, rows, cells, chars)
        self.depth, self.out, self.cut, self.cell = 0, [], False, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                if len(self.out) < self.most[0]:
                    self.out.append([])
                else:
                    self.cut, self.depth = True, 99
        elif self.depth == 1 and tag == "tr":
            self.out[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth = 0 if self.depth == 99 else self.depth - 1
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            text = " ".join(" ".join(self.cell).split())
            self.cut |= len(text) > self.most[3]
            if not self.out[-1]:
                self.out[-1].append([])
            self.out[-1][-1].append(text[: self.most[3]])
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and self.depth:
            self.cell.append(data)


def tables_of(html: str | None, tables: int = 12, rows: int = 120, cells: int = 40, chars: int = 1000) -> tuple[list[list[list[str]]], bool]:
    """The rows of a page's outermost tables within the given limits, and whether anything was cut."""
    p = _Tables(tables, rows, cells, chars)
    p.feed(html or "")
    p.close()
    cut = p.cut or any(len(t) > rows or any(len(r) > cells for r in t) for t in p.out)
    return [[r[:cells] for r in t[:rows] if r] for t in p.out], cut


@F.pandas_udf(T.StructType().add("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))).add("truncated", T.BooleanType()))
def _html_tables(s: pd.Series) -> pd.DataFrame:
    got = [tables_of(x) for x in s]
    return pd.DataFrame({"tables": [t for t, _ in got], "truncated": [c for _, c in got]})


def html_tables(df: DataFrame, html: str, name: str = "tables") -> DataFrame:
    """`df` with a struct (tables, truncated) of the page's outermost tables."""
    return share_code(df).withColumn(name, _html_tables(F.col(html)))


def reported_texts(facts: DataFrame, classes: Sequence[tuple[str, Sequence[str]]], most: int = 160, longest: int = 4000) -> DataFrame:
    """(path, fact, concept, language, class, text, truncated): the first `most` texts of each filing, by concept and fact.

    facts as `xbrl_facts` gives them; those without a language or text don't count. Markup is stripped; longer texts are
    cut to `longest` characters and flagged.
    """
    from finstrata.operators.ranking import best_per_group

    t = visible_text(facts.filter("language IS NOT NULL AND trim(value) <> ''"), "value", "visible").filter("trim(visible) <> ''")
    one = t.select("path", "fact", "concept", "language", ordered_class(F.concat_ws(" ", "concept", "visible"), classes).alias("class"), F.left("visible", F.lit(longest)).alias("text"), (F.length("visible") > longest).alias("truncated"))
    return best_per_group(one, ["path"], [F.col("concept").asc(), F.col("fact").asc()], most)


def first_annual(filings: DataFrame, entity: str, end: str, annual: str, within: int = 12) -> DataFrame:
    """(entity, filing...): each entity's newest filing that is annual, among its `within` newest; audit counts how many newer ones aren't."""
    from finstrata.operators.ranking import best_per_group

    near = best_per_group(filings, [entity], [F.col(end).desc_nulls_last(), F.col("filing_id").desc()], within, "place")
    first = best_per_group(near.filter(F.col(annual)), [entity], [F.col("place").asc()])
    return first.withColumn("passed_over", F.col("place") - 1).drop("place")
