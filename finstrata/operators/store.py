"""Write semantics on files: merges, snapshot replacement, integrity checks. Tables are DataFrames; nothing is updated in place."""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.operators.ranking import best_per_group


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])


def upsert_last(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The last row per key by `sequence`, whichever table it is in. Null keys are a key."""
    return best_per_group(old.unionByName(new), keys, [F.col(s).desc_nulls_last() for s in sequence])


def upsert_keep(old: DataFrame, new: DataFrame, keys: Sequence[str], prefer: str = "new", update: Sequence[str] | None = None) -> DataFrame:
    """Merge by key, null-safe: of two values the old (prefer='old') or new one wins unless it is null.

    Only the columns in `update` change in rows both tables have, all but the keys by default. Keys must be
    unique within either table.
    """
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c not in keys]
    out = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    there = F.col("o.__there")
    for c in cols:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        both = F.coalesce(a, b) if prefer == "old" else F.coalesce(b, a)
        if update is not None and c not in update:
            both = F.when(there, a).otherwise(b)
        out.append(both.alias(c))
    return o.withColumn("__there", F.lit(True)).alias("o").join(n, _same(keys), "full").select(*out)


def replace_snapshot(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` without the keys that `new` has any row of, and all of `new`."""
    gone = new.select(*keys).distinct().alias("n")
    return old.alias("o").join(gone, _same(keys), "left_anti").unionByName(new)


def violations(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys..., rule): a row per broken rule; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def require_empty(df: DataFrame, what: str) -> None:
    """Raise with up to five rows if `df` has any."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repair_keep(df: DataFrame, parents: DataFrame, parent_key: str, unique: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows that have a parent, of those that repeat `unique` the best in `order`."""
    return best_per_group(df.join(parents.select(parent_key).distinct(), parent_key, "left_semi"), unique, order)


def write_swapped(df: DataFrame, path: str) -> None:
    """Write beside `path` and put the finished folder in its place, so that readers see all or nothing.

    For file systems with directory renames. `df` may read from `path`.
    """
    tmp, old = f"{path}.writing", f"{path}.replaced"
    shutil.rmtree(tmp, ignore_errors=True)
    df.write.parquet(tmp)
    shutil.rmtree(old, ignore_errors=True)
    if os.path.exists(path):
        os.rename(path, old)
    os.rename(tmp, path)
    shutil.rmtree(old, ignore_errors=True)
