"""Trees and mappings: shapes of mappings, shortest translations, closures, parents by file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.session import cut_lineage


def mapping_shape(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """edges (scope..., src, dst) with shape: one_to_one, one_to_many, many_to_one or many_to_many within the scope."""
    e = edges.select(*scope, "src", "dst").distinct()
    out = e.groupBy(*scope, "src").agg(F.count(F.lit(1)).alias("n_out"))
    into = e.groupBy(*scope, "dst").agg(F.count(F.lit(1)).alias("n_in"))
    left = F.when(F.col("n_in") > 1, "many").otherwise("one")
    right = F.when(F.col("n_out") > 1, "many").otherwise("one")
    return e.join(out, [*scope, "src"]).join(into, [*scope, "dst"]).select(*scope, "src", "dst", F.concat_ws("_to_", left, right).alias("shape"))


def translations(edges: DataFrame, starts: DataFrame, target: str, max_hops: int = 4) -> DataFrame:
    """(start, path, hops): all shortest paths from each start node to any node of the target system.

    edges (src, dst) join nodes written `system:code` and count in both directions; starts (start). A path isn't continued past a target
    node; a start in the target system itself goes on to another node of it. Starts without a path within max_hops have a row with nulls.
    Nodes are first labelled with their distance to the target, one search for all starts; a path then only
    takes edges that lower the distance, so no detour is ever open and a shortest path visits no node twice.
    """
    e = cut_lineage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct())
    there = lambda c: F.col(c).startswith(f"{target}:")
    level = e.filter(there("dst")).select(F.col("dst").alias("node")).distinct().withColumn("away", F.lit(0))
    labels = level
    for d in range(1, max_hops):
        step = e.join(level.select(F.col("node").alias("dst")), "dst").filter(~there("src")).select(F.col("src").alias("node")).distinct()
        level = cut_lineage(step.join(labels, "node", "left_anti").withColumn("away", F.lit(d)))
        labels = labels.unionByName(level)
    labels = cut_lineage(labels)
    s = starts.select("start").distinct()
    onward = e.join(labels.withColumnRenamed("node", "dst"), "dst")
    # a start's first step leads to its nearest neighbours
    first = s.join(onward, F.col("start") == F.col("src")).select("start", "dst", "away")
    near = first.groupBy("start").agg(F.min("away").alias("least"))
    open_ = first.join(near, "start").filter("away = least").select("start", F.array("start", "dst").alias("path"), "away", (F.col("least") + 1).alias("hops"))
    for d in range(max_hops - 1, 0, -1):
        step = onward.filter(F.col("away") == d - 1).select(F.col("src").alias("at"), "dst", F.col("away").alias("next"))
        moving = open_.filter(F.col("away") == d).withColumn("at", F.element_at("path", -1)).join(step, "at")
        open_ = open_.filter(F.col("away") != d).unionByName(moving.select("start", F.concat("path", F.array("dst")).alias("path"), F.col("next").alias("away"), "hops"))
    return s.join(open_.select("start", "path", "hops"), "start", "left")


def closure(edges: DataFrame, max_depth: int = 20) -> DataFrame:
    """(node, ancestor, depth, path) of a tree given as (node, parent): every ancestor of every node, itself at depth 0.

    Raises on a cycle or a tree deeper than max_depth.
    """
    up = edges.select("node", "parent")
    level = up.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = level
    for d in range(1, max_depth + 2):
        level = cut_lineage(level.join(up.select(F.col("node").alias("ancestor"), F.col("parent").alias("next")), "ancestor").filter("next IS NOT NULL").select("node", F.col("next").alias("ancestor"), F.lit(d).alias("depth"), F.concat("path", F.array("next")).alias("path")))
        if level.isEmpty():
            return out
        if d > max_depth or not level.filter(F.array_size("path") > F.array_size(F.array_distinct("path"))).isEmpty():
            raise ValueError("the tree has a cycle or is too deep")
        out = out.unionByName(level)
    return out


def fill_parents(df: DataFrame, scope: Sequence[str], order: str, level: str, code: str) -> DataFrame:
    """Adds parent: the last code one level up before the row in its scope's order; null at level 1 and for rows without a level.

    A scope is one classification as published, some thousand rows in file order. A shallower row ends all deeper levels before it. The
    query fails on a row with a level above 1 that has no parent, or from level 3 on one whose code doesn't begin with its parent's.
    """
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("string")
    for k in range(2, 7):
        # the last row of at most that level: one further up says that the level has no code yet
        above = F.last(F.when(F.col(level) < k, F.struct(F.col(level).alias("l"), F.col(code).alias("c"))), ignorenulls=True).over(w)
        parent = F.when((F.col(level) == k) & (above.l == k - 1), above.c).otherwise(parent)
    right = F.col("parent").isNotNull() & ((F.col(level) == 2) | F.startswith(code, "parent"))
    out = df.withColumn("parent", parent)
    return out.withColumn("parent", F.when((F.col(level) > 1) & ~right, F.raise_error(F.concat(F.lit("no parent that fits for "), F.col(code)))).otherwise(F.col("parent")))


#: Shapes of classification codes by level.
CODE_SHAPES = ("^[A-Z]$", r"^\d{2}$", r"^\d{2}\.\d$", r"^\d{2}\.\d{2}$", r"^\d{2}\.\d{2}\.\d$", r"^\d{2}\.\d{2}\.\d{2}$")


def code_level(code: Column) -> Column:
    """1 to 6 by the code's shape, null for another."""
    out = None
    for k, shape in enumerate(CODE_SHAPES, start=1):
        out = F.when(code.rlike(shape), k) if out is None else out.when(code.rlike(shape), k)
    return out


def level_counts(df: DataFrame, expected: dict[int, int]) -> DataFrame:
    """(level, n, expected, ok): codes of each level against what a published catalogue holds."""
    spark = df.sparkSession
    want = spark.createDataFrame(sorted(expected.items()), "level int, expected bigint")
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("n")).join(want, "level", "full").select("level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("ok"))
