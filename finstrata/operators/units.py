"""Amounts of several currencies and scales in one unit.

Method: units are nodes of a graph, conversions its edges, each an affine function
y = a*x + b. The shortest composition from every unit to the target is found once on the
driver (the graph has one node per spelling-free unit, so its size is bounded), every cycle is
checked for consistency, and the resulting table is equi-joined with the rows on their unit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions.text import squeeze

# Spellings of currencies, as regular expressions over lower-case words.
CURRENCY_WORDS = {
    "EUR": r"€|eur|euro|eura|euri|euros|eurima",
    "HRK": r"hrk|kn|kuna|kune|kunama",
    "BAM": r"bam|km|marka|maraka|marks",
    "RSD": r"rsd|din|dinar|dinara|dinari|dinars",
    "USD": r"usd|us\$|\$|dolar|dolara|dollar|dollars",
}
# Spellings of scales. A lone m, k or t is a scale only beside a currency.
SCALE_WORDS = {
    1_000: r"'?000|tis|tisuć\p{L}*|tisuc\p{L}*|tisoč\p{L}*|hiljad\p{L}*|thousands?|tsd|thsd",
    1_000_000: r"mil|mio|mln|millions?|milijun\p{L}*|milijon\p{L}*|milion\p{L}*",
    1_000_000_000: r"mlrd|mrd|milijard\p{L}*|bn|billions?",
}
SHORT_SCALES = {1_000: "k|t", 1_000_000: "m", 1_000_000_000: "b"}
# Words that may stand in a unit without saying anything.
FILLER_WORDS = r"in|u|of|iznosi|amounts|amount|expressed|iskazano|izraženo|i"

#: The graph has at most so many units, or the table isn't a table of units.
MAX_UNITS = 20_000


class Edge(NamedTuple):
    """to = scale * from + shift"""

    src: str
    dst: str
    scale: float
    shift: float = 0.0


class InconsistentUnits(ValueError):
    """Two compositions of conversions between the same units disagree."""


def compositions(edges: Iterable[Edge], target: str, tolerance: float = 1e-9) -> dict[str, tuple[float, float, int]]:
    """unit -> (scale, shift, steps) of the shortest composition to `target`.

    Every edge counts in both directions. Units with no way to the target are left out. An edge
    off the shortest tree closes a cycle; if the way over it gives another function than the tree,
    InconsistentUnits is raised, in every part of the graph that holds an edge.
    """
    around: dict[str, list[tuple[str, float, float]]] = {target: []}
    edges = list(edges)
    for e in edges:
        if e.scale == 0:
            raise InconsistentUnits(f"{e.src} -> {e.dst}: a scale of 0 can't be inverted")
        around.setdefault(e.dst, []).append((e.src, e.scale, e.shift))
        around.setdefault(e.src, []).append((e.dst, 1 / e.scale, -e.shift / e.scale))
    ways: dict[str, dict[str, tuple[float, float, int]]] = {}
    seen: dict[str, str] = {}
    for root in [target, *around]:
        if root in seen:
            continue
        ways[root], seen[root], queue = {root: (1.0, 0.0, 0)}, root, deque([root])
        while queue:
            at = queue.popleft()
            a, b, n = ways[root][at]
            for unit, s, t in around[at]:
                if unit not in seen:
                    seen[unit] = root
                    ways[root][unit] = (a * s, a * t + b, n + 1)
                    queue.append(unit)
    for e in edges:
        a, b, _ = ways[seen[e.dst]][e.dst]
        c, d, _ = ways[seen[e.src]][e.src]
        if abs(a * e.scale - c) > tolerance * abs(c) or abs(a * e.shift + b - d) > tolerance * max(1.0, abs(d)):
            raise InconsistentUnits(f"{e.src} -> {e.dst} disagrees with another composition of the same units")
    return ways[target]


def money_edges(rates: Iterable[tuple[str, float]], scales: Iterable[float], base: str = "EUR") -> list[Edge]:
    """Edges of money units named `<currency>*<scale>`: each scale to single units, each currency to `base`."""
    out = []
    for currency, per_base in rates:
        if currency != base:
            out.append(Edge(f"{currency}*1", f"{base}*1", 1 / per_base))
        out += [Edge(f"{currency}*{s}", f"{currency}*1", float(s)) for s in scales if str(s) != "1"]
    return out


def _words(alternatives: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}$])(?:{alternatives})(?![\p{{L}}\p{{N}}])"


def _unit_pattern() -> str:
    """A piece of a text that states a unit: a separator or a word."""
    cur = "|".join(CURRENCY_WORDS.values())
    short = "|".join(SHORT_SCALES.values())
    word = "|".join([*SCALE_WORDS.values(), cur, FILLER_WORDS])
    return rf"[\s.,/()\[\]-]|\G(?:(?:{short})?(?:{cur})(?:{short})?|{short}|{word})(?![\p{{L}}\p{{N}}])"


def unit_text(c: Column) -> Column:
    return F.lower(squeeze(c))


def stated_currency(t: Column) -> Column:
    """Code of the currency that the lower-case unit text `t` states, else null."""
    short = "|".join(SHORT_SCALES.values())
    out = None
    for code, words in CURRENCY_WORDS.items():
        hit = t.rlike(rf"(?<![\p{{L}}\p{{N}}$])(?:{short})?(?:{words})(?:{short})?(?![\p{{L}}\p{{N}}])")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def stated_scale(t: Column) -> Column:
    """Scale that the lower-case unit text `t` states, else null."""
    cur = "|".join(CURRENCY_WORDS.values())
    out = None
    for scale, words in SCALE_WORDS.items():
        s = SHORT_SCALES[scale]
        hit = t.rlike(rf"{_words(words)}|(?<![\p{{L}}\p{{N}}])(?:{s})\s?(?:{cur})(?![\p{{L}}\p{{N}}])|(?<!\p{{L}})(?:{cur})\s?(?:{s})(?![\p{{L}}\p{{N}}])")
        out = F.when(hit, scale) if out is None else out.when(hit, scale)
    return out


def label_marker(label: Column) -> Column:
    """The end of a label that may state a unit: a last bracket, or what follows the last comma, colon or dash."""
    tail = F.regexp_extract(label, r"(?:[(\[][^()\[\]]*+[)\]]\s*+|(?:[,;:]|\s[–-]\s)[^,;:()\[\]–-]*+)$", 0)
    return F.trim(F.regexp_replace(F.lower(tail), r"^[\s,;:–(\[-]++|(?<![\s)\]])[\s)\]]++$", ""))


def whole_unit(t: Column) -> Column:
    """`t` where it consists of unit words only, whatever its length, else null; each piece begins where the one before ended."""
    return F.when((t != "") & (F.regexp_replace(t, _unit_pattern(), "") == ""), t)


def stated_units(facts: DataFrame, reports: DataFrame, value: str = "value") -> DataFrame:
    """(fact_id, value, currency, scale): money facts with a value and the unit each is recorded in.

    Currency and scale come, each on its own, from the most specific place that states it: the end
    of the label, the unit, the report; else HRK for periods that end by 2022 and EUR later, and 1.
    A report that is missing has its period from the year in the path; with no year at all the period
    counts as later. Of several rows of a report one with both set is taken. NaN counts as null.
    """
    rep = (
        reports.filter("local_path IS NOT NULL")
        .select(
            "local_path",
            stated_currency(unit_text(F.col("currency"))).alias("r_currency"),
            F.when((F.col("scale") > 0) & ~F.isnan("scale"), F.col("scale")).alias("r_scale"),
            F.coalesce(F.year("period_end"), F.col("year")).alias("r_year"),
        )
        .groupBy("local_path")
        .agg(F.max("r_currency").alias("r_currency"), F.max("r_scale").alias("r_scale"), F.max("r_year").alias("r_year"))
    )
    own = facts.filter((F.col("statement").isNull() | (F.col("statement") != "general_data")) & F.col(value).isNotNull() & ~F.isnan(value)).select(
        "fact_id", "local_path", F.col(value).alias("value"),
        whole_unit(label_marker(F.col("label"))).alias("l"), whole_unit(unit_text(F.col("unit"))).alias("u"),
    )
    own = own.select(
        "fact_id", "local_path", "value",
        F.coalesce(stated_currency(F.col("l")), stated_currency(F.col("u"))).alias("currency"),
        F.coalesce(stated_scale(F.col("l")), stated_scale(F.col("u"))).cast("double").alias("scale"),
    )
    path_year = F.regexp_extract("local_path", r"/((?:19|20)\d\d)/", 1)
    year = F.coalesce("r_year", F.when(path_year != "", path_year.cast("int")))
    return own.join(rep, "local_path", "left").select(
        "fact_id", "value",
        F.coalesce("currency", "r_currency", F.when(year <= 2022, "HRK").otherwise("EUR")).alias("currency"),
        F.coalesce("scale", "r_scale", F.lit(1.0)).alias("scale"),
    )


def conversion_table(spark: SparkSession, rates: DataFrame, scales: DataFrame, base: str = "EUR") -> DataFrame:
    """(unit_currency, unit_scale, a, b) for every money unit; at most MAX_UNITS rows, which is checked."""
    got = rates.filter("currency IS NOT NULL AND units_per_eur > 0").select("currency", "units_per_eur").distinct().limit(MAX_UNITS + 1).collect()
    seen = scales.select(F.col("scale").cast("double").alias("scale")).filter("scale > 0").distinct().limit(MAX_UNITS + 1).collect()
    steps = sorted({1.0, *map(float, SCALE_WORDS), *(r.scale for r in seen)})
    if len(got) * len(steps) > MAX_UNITS:
        raise ValueError(f"{len(got)} rates and {len(steps)} scales are no table of units")
    names = {("1" if s == 1 else repr(s)): s for s in steps}
    ways = compositions(money_edges([(r.currency, r.units_per_eur) for r in got], names, base), f"{base}*1")
    rows = [(u.split("*")[0], names[u.split("*")[1]], a, b) for u, (a, b, _) in ways.items()]
    return spark.createDataFrame(rows, "unit_currency string, unit_scale double, a double, b double")


def to_base(facts: DataFrame, reports: DataFrame, rates: DataFrame, base: str = "EUR") -> DataFrame:
    """(fact_id, value, currency, scale, amount): every money fact in single units of `base`, unrounded.

    A row of facts gives a row, repeats included; facts of statement `general_data` and facts
    without a value give none. amount is null where no conversion from the currency is known.
    """
    spark = facts.sparkSession
    table = conversion_table(spark, rates, reports.select("scale"), base)
    rows = stated_units(facts, reports)
    on = (F.col("currency") == F.col("unit_currency")) & (F.col("scale") == F.col("unit_scale"))
    return rows.join(F.broadcast(table), on, "left").select("fact_id", "value", "currency", "scale", (F.col("value") * F.col("a") + F.col("b")).alias("amount"))
