"""Workbooks as DataFrames.

Python only unzips: `cells` turns every workbook into rows of cells, executor-side and with nothing
but the standard library. All that follows (sheet names, header facts, units, statement rows) are
DataFrame operations over the cells of all workbooks at once.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.functions.exprs import european_number, parse_date
from finstrata.session import share_code

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates.
_DATE_FORMATS = frozenset([*range(14, 23), 45, 46, 47])
#: Larger files aren't opened; their row says so.
MAX_BYTES = 100 * 1024 * 1024


class NotAWorkbook(ValueError):
    """The bytes aren't a zip container with the parts of a workbook."""


def _column(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    n = 0
    for c in m[1]:
        n = n * 26 + ord(c) - 64
    return int(m[2]), n


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")) for n in root.iter(f"{_M}numFmt") if re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", "")), re.I)}
    xfs = root.find(f"{_M}cellXfs")
    return {i for i, xf in enumerate(xfs if xfs is not None else []) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | own}


def cells_of(data: bytes) -> Iterator[tuple[str, int, int, int, str, str | None, float | None]]:
    """(sheet, number of the sheet, row, column, kind, text, number) of each filled cell; kinds: text, number, date, boolean."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = set(z.namelist())
    except zipfile.BadZipFile as e:
        raise NotAWorkbook(str(e)) from e
    if not {"[Content_Types].xml", "xl/workbook.xml"} <= names:
        raise NotAWorkbook("the container lacks the parts of a workbook")
    shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")] if "xl/sharedStrings.xml" in names else []
    dates = _date_styles(z)
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for no, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet")):
        part = targets[sheet.get(f"{_R}id")].lstrip("/")
        at = part if part.startswith("xl/") else f"xl/{part}"
        for c in ET.fromstring(z.read(at)).iter(f"{_M}c"):
            row, col = _column(c.get("r"))
            v, kind = c.find(f"{_M}v"), c.get("t", "n")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_M}t"))
            elif v is None or v.text is None:
                continue
            else:
                text = shared[int(v.text)] if kind == "s" else v.text
            if kind in ("s", "str", "inlineStr"):
                yield sheet.get("name"), no, row, col, "text", text, None
            elif kind == "b":
                yield sheet.get("name"), no, row, col, "boolean", text, float(text)
            elif kind == "n":
                if int(c.get("s", 0)) in dates:
                    day = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(text))
                    yield sheet.get("name"), no, row, col, "date", day.date().isoformat(), float(text)
                else:
                    yield sheet.get("name"), no, row, col, "number", text, float(text)


_CELLS = "path string, sheet string, sheet_no int, row int, col int, kind string, text string, number double, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]
    names = [x.split()[0] for x in _CELLS.split(", ")]
    for b in batches:
        for path, size, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                if size > MAX_BYTES:
                    raise NotAWorkbook(f"{size} bytes are more than {MAX_BYTES}")
                rows = [(path, *c, None) for c in cells_of(data)]
            except (NotAWorkbook, ET.ParseError, KeyError, ValueError, IndexError, zipfile.BadZipFile) as e:
                rows = [(path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of every workbook under `path`; a file that can't be read has one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return share_code(files).select("path", "length", "content").mapInArrow(_read, _CELLS)


# Names of the sheets, the statement each holds and its value columns.
GENERAL = ("General data", "Opći podaci", "Opci podaci")
SHEETS = {
    "balance_sheet": (("Balance sheet", "Bilanca"), {8: "previous_period", 9: "current_period"}),
    "income_statement": (("P&L", "RDG"), {8: "previous_cumulative", 9: "previous_quarter", 10: "current_cumulative", 11: "current_quarter"}),
    "cash_flow_direct": (("CF_D", "NT_D"), {8: "previous_period", 9: "current_period"}),
    "cash_flow_indirect": (("CF_I", "NT_I"), {8: "previous_period", 9: "current_period"}),
}
LABEL_COLUMN, CODE_COLUMN = 1, 7


def _sheet_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _is_sheet(names: tuple[str, ...]) -> Column:
    return _sheet_key(F.col("sheet")).isin(*[n.lower() for n in names])


def report_headers(c: DataFrame) -> DataFrame:
    """One row per workbook: issuer_name, period_start, period_end, year, quarter, consolidated, audited (1, 0 or null).

    A value is the first filled cell right of its label; the period is the first row of the upper 15 with two dates.
    """
    g = c.filter(_is_sheet(GENERAL))
    labels = {
        "year": ("year:", "godina:"), "quarter": ("quarter:", "kvartal:"), "issuer_name": ("name of the issuer", "tvrtka izdavatelja", "naziv izdavatelja"),
        "scope": ("consolidated report", "konsolidirani izvještaj", "konsolidirani izvjestaj"), "audit": ("audited", "revidirano"),
    }
    text = F.lower("text")
    which = None
    for name, words in labels.items():
        hit = (F.col("kind") == "text") & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        which = F.when(hit, name) if which is None else which.when(hit, name)
    marked = g.withColumn("label", which)
    at = marked.filter("label IS NOT NULL").select("path", "label", F.col("row").alias("l_row"), F.col("col").alias("l_col"))
    right = at.join(g.select("path", "row", "col", "text"), "path").filter("row = l_row AND col > l_col AND trim(text) <> ''")
    value = right.groupBy("path", "label").agg(F.min_by("text", F.struct("l_row", "l_col", "col")).alias("v"))
    wide = value.groupBy("path").agg(*[F.max(F.when(F.col("label") == n, F.col("v"))).alias(n) for n in labels])
    days = g.filter("row <= 15 AND col <= 12").withColumn("d", F.when(F.col("kind").isin("date", "text"), parse_date(F.col("text")))).filter("d IS NOT NULL")
    two = days.groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct("col", "d"))).alias("ds")).filter(F.size("ds") >= 2)
    period = two.groupBy("path").agg(F.min_by("ds", "row").alias("ds")).select("path", F.col("ds")[0]["d"].alias("period_start"), F.col("ds")[1]["d"].alias("period_end"))
    number = lambda n: F.regexp_extract(n, r"(\d+)", 1).try_cast("int")
    flag = lambda n, yes, no: F.when(F.upper(F.trim(n)) == yes, 1).when(F.upper(F.trim(n)) == no, 0)
    every = c.filter("error IS NULL").select("path").distinct()
    return every.join(wide, "path", "left").join(period, "path", "left").select(
        "path", F.trim("issuer_name").alias("issuer_name"), "period_start", "period_end", number("year").alias("year"), number("quarter").alias("quarter"),
        flag("scope", "KD", "KN").alias("consolidated"), flag("audit", "RD", "RN").alias("audited"),
    )


def sheet_units(c: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, sheet, currency, scale, stated): what the upper left of each statement sheet says, else by the period."""
    top = c.filter("row <= 12 AND col <= 6 AND kind = 'text'").withColumn("t", F.lower("text"))
    cur = F.when(F.col("t").rlike(r"\bhrk\b|kuna"), "HRK").when(F.col("t").rlike(r"\beur\b|euro|eurima"), "EUR")
    u = top.groupBy("path", "sheet").agg(F.min_by(cur, F.when(cur.isNotNull(), F.struct("row", "col"))).alias("said"), F.max(F.when(F.col("t").rlike("thousand|000|tisuć"), 1000.0)).alias("scale"))
    y = F.coalesce(F.year("period_end"), F.col("year"))
    return u.join(headers.select("path", y.alias("y")), "path", "left").select("path", "sheet", F.coalesce("said", F.when(F.col("y") <= 2022, "HRK").otherwise("EUR")).alias("currency"), F.coalesce("scale", F.lit(1.0)).alias("scale"), F.col("said").isNotNull().alias("stated"))


def statement_facts(c: DataFrame, headers: DataFrame) -> DataFrame:
    """(local_path, statement, adp_code, label, column_name, value, unit, source_sheet, source_row) of every statement row.

    Rows need a code of 0 or more and a label with a letter; a row of column numbers has none. Values are in
    single units; a filled cell that isn't a number gives null, as does an empty one.
    """
    sheets, names, columns = None, [], None
    for statement, (aliases, cols) in SHEETS.items():
        hit = _is_sheet(aliases)
        sheets = F.when(hit, statement) if sheets is None else sheets.when(hit, statement)
        m = F.create_map(*[x for k, v in cols.items() for x in (F.lit(k), F.lit(v))])
        columns = F.when(F.col("statement") == statement, m) if columns is None else columns.when(F.col("statement") == statement, m)
        names.append(statement)
    s = c.withColumn("statement", sheets).filter("statement IS NOT NULL")
    value = F.coalesce("number", european_number(F.col("text")))
    rows = s.groupBy("path", "sheet", "statement", "row").agg(
        F.max(F.when(F.col("col") == LABEL_COLUMN, F.trim("text"))).alias("label"), F.max(F.when(F.col("col") == LABEL_COLUMN, F.col("kind"))).alias("label_kind"),
        F.max(F.when(F.col("col") == CODE_COLUMN, value)).alias("code"), F.map_from_entries(F.collect_list(F.struct("col", value.alias("v")))).alias("at"),
    )
    rows = rows.filter("code >= 0 AND label <> '' AND NOT label RLIKE '^[0-9]+[.]?$' AND (code >= 1 OR label_kind = 'text')")
    long = rows.select("path", "sheet", "statement", "row", "label", F.col("code").cast("int").alias("adp_code"), "at", F.explode(columns).alias("col", "column_name"))
    return long.join(sheet_units(c, headers), ["path", "sheet"], "left").select(
        F.col("path").alias("local_path"), "statement", "adp_code", "label", "column_name",
        (F.try_element_at("at", "col") * F.coalesce("scale", F.lit(1.0))).alias("value"), F.coalesce("currency", F.lit("EUR")).alias("unit"), F.col("sheet").alias("source_sheet"), F.col("row").alias("source_row"),
    )


def repeated_facts(facts: DataFrame) -> DataFrame:
    """Cells a workbook states twice; a template that changed."""
    return facts.groupBy("local_path", "statement", "adp_code", "column_name", "source_sheet").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("source_row")).alias("rows")).filter("n > 1")


# Words of labels that state numbers of employees, in folded text.
STAFF = ("zaposlen", "employee")
STAFF_COST = ("trosak zaposlen", "employee cost", "staff cost", "placa", "salary", "wage")
STAFF_AVERAGE = ("prosjec", "average")
STAFF_AT_END = (
    "na dan", "na 31", "na kraju", "krajem", "at 31", "as at", "at period end", "end of period", "year end", "year-end", "broj zaposlenih", "broj zaposlenika", "number of employees", "headcount",
)
STAFF_GROUP, STAFF_COMPANY = ("grupa", "group", "koncern"), ("drustv", "company")
NOTE_SHEETS = ("biljes", "note")
_COUNT = r"\d{1,3}(?:[ .,\x{a0}]\d{3})+|\d{1,7}"
# Worth of the places beside and below a label where its number may be, near ones and the same row first.
_PLACES = [(0, d, 100 - d) for d in range(1, 7)] + [(r, c, 70 - 5 * r - c) for r in (1, 2) for c in range(4)]


def _whole_count(text: Column, number: Column) -> Column:
    """A number of people in a cell: a whole number, or text that is nothing else."""
    written = F.when(text.rlike(rf"^\s*(?:{_COUNT})\s*$"), F.regexp_replace(text, r"\D", "").try_cast("double"))
    n = F.coalesce(number, written)
    return F.when(n.between(0, 10_000_000) & (n == F.floor(n)), n)


def employee_counts(c: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, measure, scope, value, source_sheet, source_row): the number of employees that notes and general data state.

    measure: average or period_end, scope: group, company or unspecified; neither is inferred from the other. Of several
    numbers the one nearest its label counts, more if the scope is the report's; of ties the first in sheet order. A label
    may hold its number itself, years aside. Labels of costs don't count.
    """
    from finstrata.functions.text import fold

    any_of = lambda t, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    sheets = c.filter("error IS NULL AND row <= 500 AND col <= 30").withColumn("s", fold(F.col("sheet"))).filter(_is_sheet(GENERAL) | any_of(F.col("s"), NOTE_SHEETS))
    t = F.col("t")
    measure = F.when(any_of(t, STAFF_AVERAGE), "average").when(any_of(t, STAFF_AT_END), "period_end")
    scope = F.when(any_of(t, STAFF_GROUP), "group").when(any_of(t, STAFF_COMPANY), "company").otherwise("unspecified")
    labels = sheets.filter("kind = 'text'").withColumn("t", fold(F.col("text"))).filter(any_of(t, STAFF) & ~any_of(t, STAFF_COST)).select("path", "sheet", "sheet_no", "row", "col", "text", measure.alias("measure"), scope.alias("scope")).filter("measure IS NOT NULL")
    places = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + k).alias("col"), F.lit(w).alias("worth")) for r, k, w in _PLACES])
    near = labels.select("path", "sheet", "sheet_no", F.col("row").alias("l_row"), F.col("col").alias("l_col"), "measure", "scope", F.inline(places))
    counts = sheets.select("path", "sheet", "row", "col", _whole_count(F.col("text"), F.when(F.col("kind") == "number", F.col("number"))).alias("value")).filter("value IS NOT NULL")
    beside = near.join(counts, ["path", "sheet", "row", "col"]).select("path", "sheet", "sheet_no", "l_row", "l_col", "measure", "scope", "worth", "value")
    tokens = F.transform(F.regexp_extract_all("text", F.lit(rf"(?<!\d)({_COUNT})(?!\d)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", "").try_cast("double"))
    own = F.try_element_at(F.filter(tokens, lambda v: ~v.between(1900, 2100)), F.lit(1))
    inside = labels.select("path", "sheet", "sheet_no", F.col("row").alias("l_row"), F.col("col").alias("l_col"), "measure", "scope", F.lit(40).alias("worth"), own.alias("value")).filter("value IS NOT NULL")
    found = beside.unionByName(inside.join(beside.select("path", "sheet", "l_row", "l_col").distinct(), ["path", "sheet", "l_row", "l_col"], "left_anti"))
    found = found.join(headers.select("path", "consolidated"), "path", "left")
    fits = ((F.col("consolidated") == 1) & (F.col("scope") == "group")) | ((F.col("consolidated") == 0) & (F.col("scope") == "company"))
    score = F.col("worth") + F.when(fits, 20).when(F.col("scope") == "unspecified", 5).otherwise(0)
    best = found.groupBy("path", "measure", "scope").agg(F.max_by(F.struct("value", "sheet", "l_row"), F.struct(score, -F.col("sheet_no"), -F.col("l_row"), -F.col("l_col"))).alias("b"))
    return best.select("path", "measure", "scope", "b.value", F.col("b.sheet").alias("source_sheet"), F.col("b.l_row").alias("source_row"))
