"""Dated company profiles: nested bundles in, child tables out, nested reads back, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.operators.ranking import best_per_group

CHILDREN = {
    "activities": "activity_key string, name string, share double, confidence double", "segments": "segment_key string, name string, share double", "products": "product_key string, name string, share double",
    "geographies": "geography_key string, name string, share double", "capacities": "capacity_key string, name string, value double, unit string", "subsidiaries": "subsidiary_key string, name string, share double",
}
KEY = ("ticker", "profile_date")


def bundle_schema() -> str:
    children = ", ".join(f"{name}: array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>" for name, fields in CHILDREN.items())
    return f"struct<profile: struct<ticker: string, profile_date: string, description: string, source_url: string>, {children}>"


def children(bundles: DataFrame, column: str = "bundle") -> dict[str, DataFrame]:
    """The header and the child tables of JSON bundles; a bundle that isn't JSON or lacks ticker or date gives nothing."""
    b = bundles.select(F.from_json(column, bundle_schema()).alias("b")).select(F.upper(F.trim("b.profile.ticker")).alias("ticker"), F.try_to_timestamp(F.col("b.profile.profile_date"), F.lit("yyyy-MM-dd")).cast("date").alias("profile_date"), "b.*").filter("ticker <> '' AND profile_date IS NOT NULL")
    out = {"profiles": b.select(*KEY, "profile.description", "profile.source_url")}
    for name in CHILDREN:
        out[name] = b.select(*KEY, F.inline(name))
    return out


def share_rules() -> dict[str, Column]:
    """What a child with a share must be: in 0..1 or not stated."""
    return {"share out of range": F.coalesce(F.col("share").between(0.0, 1.0), F.lit(True)), "no name": F.trim("name") != ""}


def as_of(profiles: DataFrame, cutoff: Column) -> DataFrame:
    """Each ticker's last profile at or before the date."""
    return best_per_group(profiles.filter(F.col("profile_date") <= cutoff), ["ticker"], [F.col("profile_date").desc()])


def nested(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per profile with its children as arrays, greatest share first, those without a share last, then by name."""
    out = tables["profiles"]
    for name, fields in CHILDREN.items():
        cols = [f.split()[0] for f in fields.split(", ")]
        first = F.struct((-F.coalesce("share" if "share" in cols else F.lit(None).cast("double"), F.lit(-1.0))).alias("o"), F.col("name").alias("n"), F.struct(*cols).alias("v"))
        rows = tables[name].groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x.v).alias(name))
        out = out.join(rows, list(KEY), "left")
    return out


def gaps(tables: dict[str, DataFrame]) -> DataFrame:
    """(ticker, profile_date, parts, missing): how many parts a profile has and the names of those it lacks."""
    out = tables["profiles"].select(*KEY)
    for name in CHILDREN:
        out = out.join(tables[name].groupBy(*KEY).agg(F.count(F.lit(1)).alias(name)), list(KEY), "left")
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(n), F.lit(0)) == 0, n) for n in CHILDREN]), lambda x: x.isNotNull())
    return out.select(*KEY, (F.lit(len(CHILDREN)) - F.size(missing)).alias("parts"), missing.alias("missing"))
