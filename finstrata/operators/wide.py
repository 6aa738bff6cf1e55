"""Attribute-value rows as one wide row per entity, with typed columns.

Method: the rows of an entity are first resolved to one value per attribute (a partial
aggregate before the shuffle, so an entity holds at most one pair per attribute), then gathered in
a key-value map, and the known keys are projected into typed columns. Values that don't cast are
kept beside the row in `cast_failures`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.text import alnum_key

#: A table can't have more attributes than this; a wider set is no set of attributes.
MAX_ATTRIBUTES = 20_000
TYPES = ("double", "bigint", "boolean", "date", "timestamp", "string")


def metric_attribute(name: Column) -> Column:
    return alnum_key(name)


def fact_attribute(statement: Column, code: Column, column: Column) -> Column:
    """`balancesheet.<code>.<column>`; null if a part is null."""
    return F.concat(alnum_key(statement), F.lit("."), code.cast("string"), F.lit("."), alnum_key(column))


def pairs(facts: DataFrame, metrics: DataFrame, statements: tuple[str, ...] = ("balance_sheet",)) -> DataFrame:
    """(local_path, attribute, value, parsed_at, tie) of all metrics and of the facts of `statements`."""
    m = metrics.select("local_path", metric_attribute(F.col("metric_name")).alias("attribute"), F.col("value").cast("double").alias("value"), "parsed_at", F.lit(0).cast("bigint").alias("tie"))
    f = facts.filter(F.col("statement").isin(*statements)).select(
        "local_path", fact_attribute(F.col("statement"), F.col("adp_code"), F.col("column_name")).alias("attribute"), F.col("value").cast("double").alias("value"), "parsed_at", F.col("fact_id").alias("tie")
    )
    return m.unionByName(f)


def resolve(rows: DataFrame) -> DataFrame:
    """(local_path, attribute, value): the value of the row parsed last among those with a value.

    Rows without path, attribute or value count for nothing, NaN counts as no value. Rows that tie
    in parsed_at: the highest fact_id, then the highest value. A null parsed_at is the oldest.
    """
    ok = rows.filter("local_path IS NOT NULL AND attribute <> '' AND value IS NOT NULL")
    if dict(rows.dtypes)["value"] == "double":
        ok = ok.filter(~F.isnan("value"))
    last = F.max_by("value", F.struct("parsed_at", "tie", "value"))
    return ok.groupBy("local_path", "attribute").agg(last.alias("value"))


def known_attributes(resolved: DataFrame) -> list[str]:
    got = [r[0] for r in resolved.select("attribute").distinct().limit(MAX_ATTRIBUTES + 1).collect()]
    if len(got) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    return sorted(got)


def _typed(value: Column, kind: str, to: str) -> Column:
    """`value` as `to`, null where it doesn't fit; a number with decimals is no whole number."""
    cast = value.try_cast(to)
    return F.when(value == F.floor(value), cast) if (kind, to) == ("double", "bigint") else cast


def to_wide(resolved: DataFrame, attributes: list[str], types: dict[str, str] | None = None, entity: str = "local_path") -> DataFrame:
    """One row per entity: its id, a column per attribute (double unless `types` says otherwise) and cast_failures.

    A cell is null where the entity has no such pair or where the value doesn't cast; in the second
    case cast_failures (a map) holds the value as text. Pairs whose attribute isn't asked for stay in
    the map `other`, which is called `_other` where an attribute has that name. With no attributes the result has the id and the two maps.
    """
    types = types or {}
    if bad := {t for t in types.values()} - set(TYPES):
        raise ValueError(f"no such types: {sorted(bad)}")
    by = resolved.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("kv"))
    kind = dict(resolved.dtypes)["value"]
    casts = [a for a in attributes if types.get(a, "double") != kind]
    at = {a: F.try_element_at("kv", F.lit(a)) for a in attributes}
    cell = {a: _typed(at[a], kind, types.get(a, "double")) if a in set(casts) else at[a] for a in attributes}
    known = F.array(*map(F.lit, attributes)) if attributes else F.array().cast("array<string>")
    failed = [F.struct(F.lit(a).alias("key"), at[a].cast("string").alias("value"), cell[a].isNull().alias("bad")) for a in casts]
    failures = F.map_from_entries(F.transform(F.filter(F.array(*failed), lambda x: x.bad & x.value.isNotNull()), lambda x: F.struct(x.key, x.value))) if failed else F.lit(None).cast("map<string,string>")
    return by.select(entity, *[c.alias(a) for a, c in cell.items()], failures.alias("cast_failures"), F.map_filter("kv", lambda k, _: ~F.array_contains(known, k)).alias("_other" if "other" in attributes else "other"))


def cells(table: DataFrame, attributes: list[str], entity: str = "local_path") -> DataFrame:
    """(entity, attribute, value): the filled cells of columns of one type, the reverse of `to_wide`."""
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}`").alias("value")) for a in attributes])
    return table.select(entity, F.inline(F.filter(each, lambda x: x.value.isNotNull())))
