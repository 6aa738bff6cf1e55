"""Looking back and ahead along an order, without one task per key.

A plain window puts all rows of a key into one task, and one key may hold a third of the
table. Here a key is split into chunks of its order column (months, say): a first window
works inside (key, chunk), a second one only over one summary row per (key, chunk), and an
equi-join brings the summaries back. The number of chunks of a key is bounded by the time
span the order column covers, not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Sequence[str],
    *,
    ahead: bool = False,
    prefix: str | None = None,
) -> DataFrame:
    """Add, for each of `values`, the nearest non-null value strictly before (or after) the row.

    The columns are called prev_<name> (next_<name> with `ahead`). Rows whose order columns tie
    have no defined order among themselves; make `order` total. Null keys form a key of their own.
    Null order values count as smallest. An empty frame gives an empty frame.
    """
    pre = prefix or ("next_" if ahead else "prev_")
    c = "__chunk"
    span = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
    pick = F.first if ahead else F.last
    asc = [F.col(o).asc_nulls_first() for o in order]
    inside = Window.partitionBy(*keys, c).orderBy(*asc).rowsBetween(*span)
    over = Window.partitionBy(*keys).orderBy(F.col(c).asc_nulls_first()).rowsBetween(*span)
    at = F.struct(*[F.struct(F.col(o).isNotNull(), F.col(o)) for o in order])
    best = F.min_by if ahead else F.max_by
    d = df.withColumn(c, chunk)
    near = d.select("*", *[pick(v, ignorenulls=True).over(inside).alias(f"__n_{v}") for v in values])
    ends = d.groupBy(*keys, c).agg(*[best(F.struct(v), F.when(F.col(v).isNotNull(), at)).getField(v).alias(f"__e_{v}") for v in values])
    far = ends.select(*keys, c, *[pick(f"__e_{v}", ignorenulls=True).over(over).alias(f"__f_{v}") for v in values])
    right = far.select(*[F.col(k).alias(f"__k_{k}") for k in [*keys, c]], *[f"__f_{v}" for v in values])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, c]]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    out = near.join(right, cond, "left")
    return out.select(*df.columns, *[F.coalesce(f"__n_{v}", f"__f_{v}").alias(f"{pre}{v}") for v in values])
