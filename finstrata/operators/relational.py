"""Relational operators without a home of their own: overlaps, precedence merges, text search, bounded picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_items(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, shared): how many items each two groups (a < b) have in common, from pairs that do share one.

    Groups meet over their items, never as all pairs of groups; an item of very many groups is
    a dimension with as many pairs as it has groups squared, so `group` is for small sets.
    """
    d = df.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    return d.alias("a").join(d.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.g") < F.col("b.g"))).groupBy(F.col("a.g").alias("a"), F.col("b.g").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


#: Groups of one class that are sent together to meet those of another.
BLOCK = 256


def overlaps(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, shared, only_a, only_b): how many items two groups (a < b) that share one have in common, and the items only either has, sorted.

    Groups of one set of items are a class, named by its least member; classes meet over their items, once for either order.
    Members follow in blocks, and blocks meet after the last shuffle, so no pair of groups is shuffled unless its class is as small, and no class is one task.
    """
    sets = df.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g IS NOT NULL AND i IS NOT NULL").groupBy("g").agg(F.array_sort(F.collect_set("i")).alias("items"))
    classes = sets.groupBy("items").agg(F.min("g").alias("x"), F.count(F.lit(1)).alias("n"))
    blocks = sets.join(classes, "items").groupBy("x", F.pmod(F.xxhash64("g"), F.ceil(F.col("n") / BLOCK)).alias("k")).agg(F.collect_list("g").alias("members"))
    keys = classes.select("x", F.explode("items").alias("i"))
    met = keys.join(keys.select(F.col("x").alias("y"), "i"), "i").filter("x <= y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    told = met.join(classes.select("x", F.col("items").alias("xs")), "x").join(classes.select(F.col("x").alias("y"), F.col("items").alias("ys")), "y")
    told = told.select("x", "y", "shared", F.array_except("xs", "ys").alias("only_x"), F.array_except("ys", "xs").alias("only_y"))
    both = told.join(blocks, "x").join(blocks.select(F.col("x").alias("y"), F.col("k").alias("l"), F.col("members").alias("others")), "y").filter("x < y OR k <= l")
    both = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y", "k", "l")  # few bytes that grow to all pairs: not to be coalesced into one task
    pairs = both.withColumn("g", F.explode("members")).withColumn("h", F.explode("others")).filter("x < y OR k < l OR g < h")
    first = F.col("g") < F.col("h")
    return pairs.select(
        F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), "shared",
        F.when(first, F.col("only_x")).otherwise(F.col("only_y")).alias("only_a"), F.when(first, F.col("only_y")).otherwise(F.col("only_x")).alias("only_b"),
    )


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the two has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def merge_precedence(sources: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """One row per key of any source with the value of the first source that states one and that source's number."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(key, F.col(value).alias(f"v{i}"))
        out = part if out is None else out.join(part, key, "full")
    vs = [F.col(f"v{i}") for i in range(len(sources))]
    origin = None
    for i, v in enumerate(vs):
        origin = F.when(v.isNotNull(), i) if origin is None else origin.when(v.isNotNull(), i)
    return out.select(key, F.coalesce(*vs).alias(value), origin.alias("origin"))


def search_labels(df: DataFrame, text: str, columns: Sequence[str], order: Sequence[Column], limit: int = 200) -> DataFrame:
    """The first `limit` (1 to 200) rows one of whose columns holds the text, case aside; wildcards in it are ordinary."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c)).contains(text.lower())
    return df.filter(hit).orderBy(*order).limit(max(1, min(200, limit)))


def with_flag(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """`df` with whether its key occurs in `other`."""
    there = other.select(F.col(other_key).alias(key), F.lit(True).alias(name)).distinct()
    return df.join(there, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def inventory(df: DataFrame, kv: Column, top: int) -> DataFrame:
    """(dimension, member, n, place): the most frequent members of each dimension of a map column, then by name."""
    from finstrata.operators.ranking import best_per_group

    n = df.select(F.explode(kv).alias("dimension", "member")).groupBy("dimension", "member").agg(F.count(F.lit(1)).alias("n"))
    return best_per_group(n, ["dimension"], [F.col("n").desc(), F.col("member").asc_nulls_last()], top, "place")
