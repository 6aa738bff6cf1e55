"""Scalar expressions of the engine: ratios, growth, periods, parsers, identifiers. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finstrata.functions.text import strip_accents

#: Fixed value: kuna per euro.
HRK_PER_EUR = 7.5345


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if either is null or b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def pct_change(now: Column, before: Column) -> Column:
    """Change in percent of the absolute earlier value, half-even to 4 places; null if that is 0 or either is null."""
    return F.bround(ratio(now - before, F.abs(before)) * 100, 4)


def cagr(first: Column, last: Column, years: Column | int, *, allow_zero_end: bool = False) -> Column:
    """Compound growth a year as a share; null unless the start is above 0 and the end above (or at, if allowed) 0."""
    y = F.lit(years) if isinstance(years, int) else years
    end_ok = last >= 0 if allow_zero_end else last > 0
    return F.when((first > 0) & end_ok & (y > 0), F.pow(ratio(last, first), F.lit(1.0).cast("double") / y.cast("double")) - 1)


def sum_present(*cs: Column) -> Column:
    """Sum of those that aren't null; null if all are."""
    total = F.lit(0.0)
    for c in cs:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(F.coalesce(*cs).isNotNull(), total)


def to_eur(value: Column, unit: Column) -> Column:
    """EUR as is, HRK divided by the fixed rate, anything else null."""
    return F.when(unit == "EUR", value).when(unit == "HRK", value / F.lit(HRK_PER_EUR))


def period_key(end: Column, year: Column, quarter: Column, path: Column) -> Column:
    """The period's end, else YYYY-Qn, else YYYY-FY, else the path. A last quarter and its year share a key."""
    return F.coalesce(end.cast("string"), F.when(quarter.between(1, 4), F.format_string("%04d-Q%d", year, quarter)), F.format_string("%04d-FY", year), path)


def period_label(end: Column, year: Column, quarter: Column) -> Column:
    known = year.isNotNull()
    return (
        F.when(known & quarter.between(1, 4), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-Q"), quarter.cast("string")))
        .when(known, F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-FY")))
        .otherwise(F.coalesce(end.cast("string"), F.lit("unknown-period")))
    )


def scope_label(flag: Column) -> Column:
    return F.when(flag == 1, "consolidated").when(flag == 0, "unconsolidated").otherwise("unknown")


def audit_label(flag: Column) -> Column:
    return F.when(flag == 1, "audited").when(flag == 0, "unaudited").otherwise("unknown")


def european_number(c: Column) -> Column:
    """`1.234,5`, `1 234,5` and `1234.5` as a double; null for anything else."""
    t = F.regexp_replace(c, r"[\s ]", "")
    t = F.when(t.rlike(r",\d*$") & t.contains("."), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when(t.rlike(r"^[-+]?\d+(?:\.\d*)?$|^[-+]?\.\d+$"), t.try_cast("double"))


#: Accepted forms of a date, in order of trial.
DATE_FORMS = ("yyyy-MM-dd", "d.M.yyyy.", "d.M.yyyy", "d/M/yyyy", "yyyy/MM/dd", "d-M-yyyy", "yyyyMMdd")


def parse_date(c: Column) -> Column:
    t = F.regexp_replace(c, r"\s+", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMS])


def first_stated(*cs: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cs])


def lei_code(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z0-9]{18}[0-9]{2}$"), t)


def isin_code(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), t)


def country_code(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z]{2}$"), t)


def file_kind(url: Column) -> Column:
    """Lower-case suffix of a URL's path, without its query."""
    return F.nullif(F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]{1,8})$", 1)), F.lit(""))


def label_key(label: Column) -> Column:
    """Comparison key of a statement label: plain lower case words, cut at a later `aop`/`adp`, without leading numerals.

    A letter with a stroke isn't decomposed and so becomes a blank, unlike in `fold`.
    """
    t = F.regexp_replace(F.lower(strip_marks(label)), "[^a-z0-9]+", " ")
    t = F.trim(F.regexp_replace(F.trim(t), r"(?<=\S) (?:aop|adp)\b.*$", ""))
    return F.regexp_replace(t, r"^(?:(?:[ivxlcdm]+|[a-z]|\d+)(?: |$))+", "")


def strip_marks(c: Column) -> Column:
    """`strip_accents`, but letters with strokes stay."""
    kept = F.translate(c, "đĐøØłŁħĦ", "\x01\x02\x03\x04\x05\x06\x07\x08")
    return F.translate(strip_accents(kept), "\x01\x02\x03\x04\x05\x06\x07\x08", "đĐøØłŁħĦ")
