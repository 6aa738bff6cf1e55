"""Full history of changing attributes, from snapshots in any order.

Method: an event-sourced change log per attribute. Every attribute gets its own change
events and hence its own validity intervals; a version of the entity begins at the union of
those boundaries, and equal neighbours are coalesced by comparing normalised values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.text import SPACE, fold
from finstrata.operators.ordered import neighbours
from finstrata.session import cut_lineage

ATTRIBUTES = ("sector", "listed_quantity", "delisting_date")
#: State of a security that isn't delisted.
NOT_DELISTED = "-"


def day_key(c: Column) -> Column:
    """A day as yyyy-MM-dd, from ISO or day-month-year text; NOT_DELISTED for null, blank and `-`; other text folded."""
    t = F.regexp_replace(c, f"{SPACE}+", "")
    iso = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})\.?(?:T.*)?$"
    dmy = r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})\.?$"

    def day(rx: str, y: int, m: int, d: int) -> Column:
        part = [F.lpad(F.regexp_extract(t, rx, g), n, "0") for g, n in ((y, 4), (m, 2), (d, 2))]
        return F.when(t.rlike(rx), F.concat_ws("-", *part))

    empty = t.isNull() | t.isin("", "-", "–", "—")
    return F.when(empty, F.lit(NOT_DELISTED)).otherwise(F.coalesce(day(iso, 1, 2, 3), day(dmy, 3, 2, 1), fold(c)))


def snapshot_states(securities: DataFrame) -> DataFrame:
    """One row per (ticker, updated_at): of several the one ingested last, then the highest snapshot_id."""
    ticker = F.upper(F.regexp_replace(F.col("ticker"), f"^{SPACE}+|{SPACE}+$", ""))
    s = securities.select(
        ticker.alias("ticker"), "updated_at", "ingested_at", "snapshot_id", "sector", "listed_quantity", "delisting_date"
    ).filter("ticker <> '' AND updated_at IS NOT NULL")
    last = F.max_by(F.struct("sector", "listed_quantity", "delisting_date"), F.struct("ingested_at", "snapshot_id", "sector", "listed_quantity", "delisting_date"))
    s = s.groupBy("ticker", "updated_at").agg(last.alias("s")).select("ticker", "updated_at", "s.*")
    sector = fold(F.col("sector"))
    return s.select(
        "ticker",
        "updated_at",
        F.struct(F.when(sector != "", sector).alias("key"), F.col("sector").alias("raw")).alias("sector"),
        F.struct(F.col("listed_quantity").cast("string").alias("key"), F.col("listed_quantity").cast("string").alias("raw")).alias("listed_quantity"),
        F.struct(day_key(F.col("delisting_date")).alias("key"), F.col("delisting_date").alias("raw")).alias("delisting_date"),
    )


def change_log(states: DataFrame) -> DataFrame:
    """(ticker, attribute, valid_from, key, raw, prev_key): the stated values that differ from the one stated before.

    prev_key is null where an attribute is stated for the first time.
    """
    long = states.select(
        "ticker", F.col("updated_at").alias("valid_from"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"{a}.key").alias("key"), F.col(f"{a}.raw").alias("raw")) for a in ATTRIBUTES])).alias("x"),
    ).select("ticker", "valid_from", "x.*").filter("key IS NOT NULL")
    seen = neighbours(long, ["ticker", "attribute"], ["valid_from"], F.date_trunc("month", "valid_from"), ["key"])
    return seen.filter("prev_key IS NULL OR prev_key <> key")


def attribute_intervals(states: DataFrame) -> DataFrame:
    """The change log with valid_to, the start of the attribute's next value (null while it holds)."""
    log = change_log(states)
    at = log.withColumn("at", F.col("valid_from"))
    return neighbours(at, ["ticker", "attribute"], ["valid_from"], F.date_trunc("month", "valid_from"), ["at"], ahead=True).select(
        "ticker", "attribute", "valid_from", F.col("next_at").alias("valid_to"), "key", "raw"
    )


def history(securities: DataFrame) -> DataFrame:
    """(ticker, valid_from, valid_to, sector, listed_quantity, delisting_date), one row per version.

    A ticker's first snapshot starts its first version; a later one starts where a stated value
    differs from the one stated before. Nulls: a null or blank sector and a null quantity are not
    stated; a null, blank or `-` delisting_date means not delisted. An attribute first stated inside
    a version counts for that whole version. valid_to is null for the current version. Rows without
    ticker or updated_at have no place and are left out; repeated rows count once. Of rows that tie in
    ticker, updated_at and ingested_at the highest snapshot_id counts. Other columns are ignored.
    """
    states = snapshot_states(securities)
    first = states.groupBy("ticker").agg(F.min("updated_at").alias("at"))
    log = change_log(states)
    events = (
        log.groupBy("ticker", F.col("valid_from").alias("at"))
        .agg(*[F.max(F.when(F.col("attribute") == a, F.col("raw" if a == "sector" else "key"))).alias(a) for a in ATTRIBUTES], F.max(F.col("prev_key").isNotNull()).alias("changes"))
        .unionByName(first.withColumn("changes", F.lit(True)), allowMissingColumns=True)
        .groupBy("ticker", "at")
        .agg(*[F.max(a).alias(a) for a in ATTRIBUTES], F.max("changes").alias("changes"))
        .withColumn("start", F.when(F.col("changes"), F.col("at")))
    )
    events = cut_lineage(events)  # the changes only; what follows reads them several times
    month = F.date_trunc("month", "at")
    carried = neighbours(events, ["ticker"], ["at"], month, [*ATTRIBUTES, "start"])
    held = carried.select("ticker", "at", F.coalesce("start", "prev_start").alias("valid_from"), *[F.coalesce(a, f"prev_{a}").alias(a) for a in ATTRIBUTES])
    versions = held.groupBy("ticker", "valid_from").agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("at"))).alias(a) for a in ATTRIBUTES])
    versions = versions.withColumn("from", F.col("valid_from"))
    out = neighbours(versions, ["ticker"], ["valid_from"], F.date_trunc("month", "valid_from"), ["from"], ahead=True)
    return out.select(
        "ticker", "valid_from", F.col("next_from").alias("valid_to"), "sector",
        F.col("listed_quantity").cast("bigint").alias("listed_quantity"),
        F.when(F.col("delisting_date") != NOT_DELISTED, F.col("delisting_date")).alias("delisting_date"),
    )
