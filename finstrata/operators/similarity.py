"""Similarity of companies: activity vectors, greedy matching, fingerprints, names."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstrata.functions.exprs import clip, ratio, strip_marks
from finstrata.session import share_code

# Likeness of two codes that agree in full, in group, in division only.
EXACT, SAME_GROUP, SAME_DIVISION = 1.0, 0.60, 0.35


def activity_vector(activities: DataFrame) -> DataFrame:
    """(ticker, code, weight): each ticker's weights scaled to 1; equal weights where none is stated.

    activities (ticker, code, share); rows without a share count only where the ticker has no share at all.
    """
    any_ = activities.groupBy("ticker").agg(F.count("share").alias("stated"))
    a = activities.join(any_, "ticker").filter(F.col("share").isNotNull() | (F.col("stated") == 0)).withColumn("w", F.when(F.col("stated") > 0, F.col("share")).otherwise(F.lit(1.0)))
    a = a.groupBy("ticker", "code").agg(F.sum("w").alias("w"))
    return a.join(a.groupBy("ticker").agg(F.sum("w").alias("total")), "ticker").select("ticker", "code", ratio(F.col("w"), F.col("total")).alias("weight"))


def code_likeness(a: Column, b: Column) -> Column:
    group = lambda c: F.substring(c, 1, 4)
    return F.when(a == b, EXACT).when(group(a) == group(b), SAME_GROUP).when(F.substring(a, 1, 2) == F.substring(b, 1, 2), SAME_DIVISION)


def greedy_match(vectors: DataFrame, target: str) -> DataFrame:
    """(ticker, score, exact, same_group, same_division): how much of the target's weight each other ticker matches.

    Pairs of codes are taken by likeness, then by the mass both still have, then by code; each takes mass
    from both. Codes meet over their division, so only pairs with some likeness are made; the stateful taking runs
    per ticker over the target's few codes.
    """
    share_code(vectors)
    t = vectors.filter(F.col("ticker") == target).select(F.col("code").alias("code_t"), F.col("weight").alias("weight_t"), F.substring("code", 1, 2).alias("division"))
    o = vectors.filter(F.col("ticker") != target).withColumn("division", F.substring("code", 1, 2))
    pairs = o.join(t, "division").select("ticker", "code", "weight", "code_t", "weight_t", code_likeness(F.col("code"), F.col("code_t")).alias("likeness"))

    def take(p: pd.DataFrame) -> pd.DataFrame:
        left, right = dict(zip(p.code, p.weight, strict=True)), dict(zip(p.code_t, p.weight_t, strict=True))
        p = p.assign(m=p[["weight", "weight_t"]].min(axis=1)).sort_values(["likeness", "m", "code", "code_t"], ascending=[False, False, True, True])
        mass = {EXACT: 0.0, SAME_GROUP: 0.0, SAME_DIVISION: 0.0}
        for r in p.itertuples():
            m = min(left[r.code], right[r.code_t])
            if m > 0:
                left[r.code] -= m
                right[r.code_t] -= m
                mass[r.likeness] += m
        return pd.DataFrame([(p.ticker.iloc[0], sum(k * m for k, m in mass.items()), mass[EXACT], mass[SAME_GROUP], mass[SAME_DIVISION])], columns=["ticker", "score", "exact", "same_group", "same_division"])

    return pairs.groupBy("ticker").applyInPandas(take, "ticker string, score double, exact double, same_group double, same_division double")


def business_band(score: Column, exact: Column, group: Column) -> Column:
    """STRONG, MODERATE, WEAK or REJECTED, by the mass of equal codes or by the score; likeness of divisions alone is never above WEAK."""
    detailed = (exact > 1e-12) | (group > 1e-12)
    return (
        F.when(detailed & ((exact >= 0.35) | (score >= 0.55)), "STRONG").when(detailed & ((exact >= 0.20) | (score >= 0.30)), "MODERATE")
        .when((exact >= 0.08) | (group >= 0.10) | (score >= 0.12), "WEAK").otherwise("REJECTED")
    )


def weighted_mean(parts: Sequence[tuple[Column, float]], least: int = 1) -> Column:
    """Mean of the parts that aren't null with their weights, null if fewer than `least` are there."""
    total, weight, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for c, w in parts:
        total = total + F.coalesce(c * w, F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), w).otherwise(0.0)
        n = n + c.isNotNull().cast("int")
    return F.when(n >= least, ratio(total, weight))


def fingerprint_similarity(features: DataFrame, target: str, scales: dict[str, tuple[float, float, float, float]], least: int = 4) -> DataFrame:
    """(ticker, similarity, common): likeness of each ticker's clipped ratios with the target's, in percent.

    features (ticker, names of `scales`), one row per ticker; scales: low, high, scale, weight. The target is one row, joined
    as values, not as a table.
    """
    row = features.filter(F.col("ticker") == target).limit(1).collect()
    if not row:
        return features.limit(0).select("ticker", F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("common"))
    parts, n = [], F.lit(0)
    for name, (low, high, scale, weight) in scales.items():
        mine = row[0][name]
        own = None if mine is None else max(low, min(high, mine))
        alike = 1 / (1 + F.abs(clip(F.col(name), low, high) - F.lit(own).cast("double")) / scale)
        parts.append((alike, weight))
        n = n + alike.isNotNull().cast("int")
    return features.filter(F.col("ticker") != target).select("ticker", (weighted_mean(parts, least) * 100).alias("similarity"), n.alias("common"))


def size_similarity(a: Column, b: Column) -> Column:
    """1 for equal sizes down to 0 at a hundredfold difference."""
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.log10(F.greatest(a, b) / F.least(a, b)) / 2))


@F.pandas_udf(T.DoubleType())
def _ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def name_key(c: Column) -> Column:
    """Lower-case words without accents or punctuation. A letter with a stroke has no accent to lose, so it becomes a blank, unlike in `fold`."""
    t = F.replace(F.replace(F.lower(strip_marks(c)), F.lit("ß"), F.lit("ss")), F.lit("ﬁ"), F.lit("fi"))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def name_similarities(names: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """`names` with the Ratcliff-Obershelp ratio of the keys of columns a and b, which isn't symmetric.

    Equal keys have 1, a name without letters and digits has 0, a null one null. Each different pair of keys is compared once, and only those
    neither equal nor empty leave the JVM.
    """
    x, y = name_key(F.col(a)), name_key(F.col(b))
    keyed = names.withColumns({"__a": x, "__b": y})
    pairs = share_code(names).select(x.alias("__a"), y.alias("__b")).filter("__a <> '' AND __b <> '' AND __a <> __b").distinct()
    told = pairs.withColumn("__s", _ratcliff("__a", "__b"))
    easy = F.when((F.col("__a") == "") | (F.col("__b") == ""), 0.0).when(F.col("__a") == F.col("__b"), 1.0)
    return keyed.join(told, ["__a", "__b"], "left").withColumn(name, F.coalesce(easy, F.col("__s"))).drop("__a", "__b", "__s")


def name_similarity(a: Column, b: Column) -> Column:
    """The same ratio of two columns of a few rows: null if either is null, 0 if one has no letters or digits."""
    x, y = name_key(a), name_key(b)
    return F.when((x == "") | (y == ""), 0.0).when(x.isNotNull() & y.isNotNull(), _ratcliff(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))


def candidate_class(same: Column, similarity: Column, country_conflict: Column) -> Column:
    """EXACT, STRONG_REVIEW from 0.92 on or REVIEW; a country that differs makes it a REVIEW."""
    return F.when(F.coalesce(country_conflict, F.lit(False)), "REVIEW").when(same, "EXACT").when(similarity >= 0.92, "STRONG_REVIEW").otherwise("REVIEW")
