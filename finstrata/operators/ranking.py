"""Choosing rows: best per group, preferred reports, latest values, coverage.

`best_per_group` filters on row_number, for which Spark limits each group before the shuffle
already (WindowGroupLimit), so a group of any size sends at most n rows per task. Counts of
candidates are a separate partial aggregate, not a window over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.exprs import period_key, period_label


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; `order` must be total for a defined result. Null keys are a group."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def tri_state(c: str) -> Column:
    """1 before null before 0, for descending order."""
    return F.when(F.col(c) == 1, 2).when(F.col(c) == 0, 0).otherwise(1).desc()


def one_row_per_report(reports: DataFrame) -> DataFrame:
    """Of repeated rows of a local_path the one parsed last."""
    return best_per_group(reports, ["local_path"], [F.col("parsed_at").desc_nulls_last(), F.col("source_id").desc_nulls_last()])


#: Newest correction first, then audited ones: later filings supersede earlier ones by rank, not by update.
def report_order() -> list[Column]:
    return [tri_state("consolidated"), F.col("source_publish_date").desc_nulls_last(), F.when(F.col("audited") == 1, 0).otherwise(1).asc(), F.col("parsed_at").desc_nulls_last(), F.col("local_path").desc()]


def with_period(reports: DataFrame) -> DataFrame:
    return reports.withColumn("period_key", period_key(F.col("period_end"), F.col("year"), F.col("quarter"), F.col("local_path"))).withColumn(
        "period_label", period_label(F.col("period_end"), F.col("year"), F.col("quarter"))
    )


def preferred_reports(reports: DataFrame) -> DataFrame:
    """The report to use for each issuer and period, with the number of candidates it was chosen from.

    Reports without issuer share one group; a last quarter and its year compete, as they end alike.
    """
    r = with_period(reports).withColumn("issuer", F.coalesce("issuer_code", F.lit("")))
    best = best_per_group(r, ["issuer", "period_key"], report_order())
    n = r.groupBy("issuer", "period_key").agg(F.count(F.lit(1)).alias("period_candidates"))
    return best.join(n, ["issuer", "period_key"])


def candidate_reports(reports: DataFrame) -> DataFrame:
    """Per issuer and period all consolidated reports, or only the preferred one where there are none."""
    r = with_period(reports).withColumn("issuer", F.coalesce("issuer_code", F.lit("")))
    any_ = r.groupBy("issuer", "period_key").agg(F.max(F.coalesce("consolidated", F.lit(0))).alias("has"))
    best = best_per_group(r, ["issuer", "period_key"], report_order()).select("local_path", F.lit(True).alias("first"))
    j = r.join(any_, ["issuer", "period_key"]).join(best, "local_path", "left")
    return j.filter(F.when(F.col("has") == 1, F.col("consolidated") == 1).otherwise(F.coalesce("first", F.lit(False)))).drop("has", "first")


def latest_metrics(metrics: DataFrame, preferred: DataFrame) -> DataFrame:
    """Each issuer's metric values from its newest preferred report that lists them; a null there isn't skipped."""
    m = metrics.join(preferred.select("local_path", "issuer", F.col("period_end").alias("r_end"), "source_publish_date"), "local_path")
    order = [F.col("r_end").desc_nulls_last(), F.col("source_publish_date").desc_nulls_last(), F.col("local_path").desc()]
    return best_per_group(m, ["issuer", "metric"], order)


def coverage(reports: DataFrame) -> DataFrame:
    """issuer x year with the best report's path for Q1..Q4 and FY: scope, then audited, then newest."""
    r = reports.filter("year IS NOT NULL").withColumn("issuer", F.coalesce("issuer_code", F.lit(""))).withColumn("slot", F.when(F.col("quarter").isNull(), "FY").otherwise(F.concat(F.lit("Q"), F.col("quarter").cast("string"))))
    order = [tri_state("consolidated"), F.when(F.col("audited") == 1, 0).otherwise(1).asc(), F.col("source_publish_date").desc_nulls_last(), F.col("local_path").desc()]
    best = best_per_group(r, ["issuer", "year", "slot"], order)
    slots = ("Q1", "Q2", "Q3", "Q4", "FY")
    return best.groupBy("issuer", "year").agg(*[F.max(F.when(F.col("slot") == s, F.col("local_path"))).alias(s.lower()) for s in slots])


def as_of(df: DataFrame, keys: Sequence[str], at: str, cutoff: Column, tie: Sequence[str]) -> DataFrame:
    """Each key's last row at or before the cutoff; keys without one are left out."""
    return best_per_group(df.filter(F.col(at) <= cutoff), keys, [F.col(at).desc(), *[F.col(t).desc() for t in tie]])
