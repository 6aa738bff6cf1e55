"""Entities and their identifiers: ids, lookup by priority, registration, nested reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.exprs import isin_code, lei_code
from finstrata.operators.store import require_empty, upsert_keep

#: Identifier schemes, strongest first.
SCHEMES = ("LEI", "ISIN", "TICKER")


def entity_id(lei: Column, isin: Column, ticker: Column, exchange: Column, name: Column) -> Column:
    """The strongest identifier as an id: LEI, ISIN, exchange:ticker, else a hash of the name; null without any."""
    t = F.nullif(F.upper(F.trim(ticker)), F.lit(""))
    local = F.concat(F.lit("LOCAL:"), F.substring(F.sha2(F.lower(F.trim(name)), 256), 1, 20))
    return F.coalesce(F.concat(F.lit("LEI:"), lei_code(lei)), F.concat(F.lit("ISIN:"), isin_code(isin)), F.concat(F.upper(F.trim(exchange)), F.lit(":"), t), local)


def identifiers(records: DataFrame) -> DataFrame:
    """(record, scheme, value): the valid identifiers of records (record, lei, isin, exchange, ticker)."""
    t = F.nullif(F.upper(F.trim("ticker")), F.lit(""))
    pair = lambda s, v: F.struct(F.lit(s).alias("scheme"), v.alias("value"))
    each = F.array(pair("LEI", lei_code(F.col("lei"))), pair("ISIN", isin_code(F.col("isin"))), pair("TICKER", F.concat(F.upper(F.trim("exchange")), F.lit(":"), t)))
    return records.select("record", F.inline(F.filter(each, lambda x: x.value.isNotNull())))


def lookup(found: DataFrame, known: DataFrame) -> DataFrame:
    """(record, entity_id, scheme, entities): the entity of each record by its strongest known identifier.

    found (record, scheme, value), known (entity_id, scheme, value). entities counts those its identifiers name together:
    more than one is a conflict. Records without a known identifier are left out.
    """
    strength = F.array_position(F.array(*map(F.lit, SCHEMES)), F.col("scheme"))
    j = found.join(known, ["scheme", "value"])
    return j.groupBy("record").agg(F.min_by("entity_id", F.struct(strength, "entity_id")).alias("entity_id"), F.min_by("scheme", F.struct(strength, "entity_id")).alias("scheme"), F.count_distinct("entity_id").alias("entities"))


def register(records: DataFrame, entities: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and identifiers after the records: each merges into the entity its identifiers name, or is a new one.

    records (record, lei, isin, exchange, ticker, name, country); entities (entity_id, name, country); new values that are
    stated replace old ones. An identifier belongs to one entity: if a record's identifiers name two, or two records
    claim one identifier for different entities, ValueError is raised and nothing changes.
    """
    ids = identifiers(records)
    at = lookup(ids, known)
    require_empty(at.filter("entities > 1"), "identifiers of several entities in one record")
    own = entity_id(F.col("lei"), F.col("isin"), F.col("ticker"), F.col("exchange"), F.col("name"))
    r = records.join(at.select("record", F.col("entity_id").alias("is")), "record", "left").withColumn("entity_id", F.coalesce("is", own)).filter("entity_id IS NOT NULL")
    claims = ids.join(r.select("record", "entity_id"), "record").select("entity_id", "scheme", "value").distinct()
    every = known.select("entity_id", "scheme", "value").unionByName(claims).distinct()
    require_empty(every.groupBy("scheme", "value").agg(F.count_distinct("entity_id").alias("n")).filter("n > 1"), "identifiers claimed by several entities")
    stated = r.groupBy("entity_id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("record"))).alias("name"), F.max_by("country", F.when(F.col("country").isNotNull(), F.col("record"))).alias("country"))
    return upsert_keep(entities.select("entity_id", "name", "country"), stated, ["entity_id"], "new"), every


def nested(entities: DataFrame, known: DataFrame) -> DataFrame:
    """Entities with their identifiers as a sorted array of (scheme, value); an empty one without any."""
    g = known.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct("scheme", "value"))).alias("identifiers"))
    return entities.join(g, "entity_id", "left").withColumn("identifiers", F.coalesce("identifiers", F.array().cast("array<struct<scheme:string,value:string>>")))


def repair_placeholder_ids(items: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and documents after `unknown-<n>` ids are replaced by the id of the item that has the same document.

    items (source_id, variant), documents (source_id, variant, url). A placeholder none of whose documents another item
    has stays; repointed documents that repeat and placeholder items left without documents are dropped.
    """
    old = F.col("source_id").rlike(r"^unknown-\d+$")
    real = documents.filter(~old).groupBy("variant", "url").agg(F.min("source_id").alias("real"))
    docs = documents.join(real, ["variant", "url"], "left").select(F.when(old & F.col("real").isNotNull(), F.col("real")).otherwise(F.col("source_id")).alias("source_id"), "variant", "url").distinct()
    left = docs.select("source_id", "variant").distinct().withColumn("has", F.lit(True))
    kept = items.join(left, ["source_id", "variant"], "left").filter(~old | F.coalesce("has", F.lit(False))).drop("has")
    return kept, docs
