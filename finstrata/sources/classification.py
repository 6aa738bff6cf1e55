"""Classifications as published: items, labels and their structure, checked against the catalogue before they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.operators.graphs import code_level, level_counts
from finstrata.operators.store import require_empty


def codelist_stubs(spark: SparkSession, path: str, tag: str = "Codelist") -> DataFrame:
    """(id, agency, version, name) of the code lists in an XML registry answer."""
    schema = "_id string, _agencyID string, _version string, Name array<struct<_VALUE:string,`_lang`:string>>"
    x = spark.read.format("xml").option("rowTag", tag).schema(schema).option("ignoreNamespace", "true").load(path)
    en = F.filter("Name", lambda n: n["_lang"] == "en")
    return x.select(F.col("_id").alias("id"), F.col("_agencyID").alias("agency"), F.col("_version").alias("version"), F.coalesce(F.try_element_at(en, F.lit(1))["_VALUE"], F.try_element_at("Name", F.lit(1))["_VALUE"]).alias("name"))


def choose_codelist(stubs: DataFrame, preferred: str, title: str, version: str) -> DataFrame:
    """The list with the preferred id if there is one, else the only one of that title and version; a null id says neither."""
    hit = F.contains(F.lower("name"), F.lit(title.lower())) & (F.col("version") == version)
    g = stubs.agg(F.count_if(F.col("id") == preferred).alias("p"), F.count_if(hit).alias("n"), F.max(F.when(hit, F.col("id"))).alias("other"))
    return g.select(F.when(F.col("p") >= 1, preferred).when(F.col("n") == 1, F.col("other")).alias("id"))


def scheme(items: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """items (concept, code, parent_concept) and labels (concept, language, kind, label) as a scheme and what is wrong with it.

    items: (code, parent, level); labels: (code, language, kind, label), each once; problems: (code, problem) for a concept
    with several codes or parents, an unknown shape, a parent that isn't there and codes without an English label.
    """
    codes = items.select("concept", "code").distinct()
    up = items.filter("parent_concept IS NOT NULL").select("concept", "parent_concept").distinct()
    parent = codes.select(F.col("concept").alias("parent_concept"), F.col("code").alias("parent"))
    out = codes.join(up, "concept", "left").join(parent, "parent_concept", "left").withColumn("level", code_level(F.col("code")))
    named = labels.join(codes, "concept").select("code", "language", "kind", "label").distinct()
    problem = lambda df, what: df.select(F.col("code").cast("string").alias("code"), F.lit(what).alias("problem"))
    bad = problem(codes.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code")).filter("n > 1"), "several codes")
    bad = bad.unionByName(problem(up.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(codes, "concept"), "several parents"))
    bad = bad.unionByName(problem(out.filter("level IS NULL"), "unknown shape")).unionByName(problem(out.filter("parent_concept IS NOT NULL AND parent IS NULL"), "missing parent"))
    bad = bad.unionByName(problem(codes.join(named.filter("language = 'en' AND kind = 'prefLabel'").select("code").distinct(), "code", "left_anti"), "no English label"))
    return {"items": out.select("code", "parent", "level"), "labels": named, "problems": bad}


def accept(parts: dict[str, DataFrame], expected: dict[int, int]) -> dict[str, DataFrame]:
    """The parts of `scheme`, if it has no problem and the catalogue's number of codes on each level; else ValueError."""
    require_empty(parts["problems"], "the classification has problems")
    require_empty(level_counts(parts["items"], expected).filter("NOT ok"), "the levels don't hold what the catalogue says")
    return parts


def structural_links(codes: DataFrame, targets: DataFrame, shape: str = r"^(\d{2}(?:\.\d{1,2})?)") -> DataFrame:
    """(code, target): the code's leading part, where the other classification has it; only codes below that level."""
    key = F.nullif(F.regexp_extract("code", shape, 1), F.lit(""))
    return codes.select("code", key.alias("target")).filter("target IS NOT NULL").join(targets.select(F.col("code").alias("target")).distinct(), "target", "left_semi").select("code", "target")


def search(items: DataFrame, labels: DataFrame, text: str, language: str | None = None, limit: int = 50) -> DataFrame:
    """(level, code, language, kind, label) where the code or a label holds the text, by level and code; limit 1 to 200."""
    hit = F.lower("label").contains(text.lower()) | F.lower("code").contains(text.lower())
    found = labels.join(items.select("code", "level"), "code").filter(hit)
    if language:
        found = found.filter(F.col("language") == language)
    return found.select("level", "code", "language", "kind", "label").orderBy("level", "code", "language", "kind", "label").limit(max(1, min(200, limit)))


def translate(nodes: DataFrame, catalogue: DataFrame, items: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, relation, code, label, mapped) of each node: its official codes, or one row that says it has none.

    catalogue (node, relation, code); the label is the first English one. A code that the classification lacks is
    an error of the catalogue: ValueError.
    """
    require_empty(catalogue.join(items.select("code"), "code", "left_anti"), "codes the classification doesn't have")
    name = labels.filter("language = 'en' AND kind = 'prefLabel'").groupBy("code").agg(F.min("label").alias("label"))
    return nodes.select("node").distinct().join(catalogue, "node", "left").join(name, "code", "left").select("node", "relation", "code", "label", F.col("code").isNotNull().alias("mapped"))


def statistical(code: Column) -> Column:
    """Whether a code has none of the legal shapes, as statistical aggregates do."""
    return code_level(code).isNull()
