"""Writes small workbooks for tests, with inline strings and one date style."""

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _ref(row, col):
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return f"{out}{row}"


def _cell(row, col, v):
    if isinstance(v, dt.date):
        return f'<c r="{_ref(row, col)}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
    if isinstance(v, str):
        return f'<c r="{_ref(row, col)}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    return f'<c r="{_ref(row, col)}"><v>{v}</v></c>'


def write(path, sheets):
    """sheets: name -> {(row, col): value}"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/styles.xml", f'<styleSheet {_NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f"<workbook {_NS}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, cells in enumerate(sheets.values(), 1):
            rows = {}
            for (r, c), v in sorted(cells.items()):
                rows.setdefault(r, []).append(_cell(r, c, v))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {_NS}><sheetData>" + "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in rows.items()) + "</sheetData></worksheet>")


#: The half-year report of an invented port. A row is (code, label, values); balance sheet: end of last year, now; income: last year's half and quarter, this year's.
PORT = {
    "Balance sheet": [
        (65, "Assets", 380, 400), (63, "Money", 44, 31), (67, "Equity", 140, 150), (89, "Minority", 10, 12), (103, "Banks, long", 75, 70), (106, "Bonds, long", 20, 20), (114, "Deposits, short", 4, 5), (115, "Banks, short", 21, 25),
    ],
    "P&L": [(1, "Operating income", 171, 88, 190, 99), (2, "Sales in the group", 11, 6, 12, 6), (3, "Sales outside", 150, 78, 168, 88), (7, "Operating costs", 149, 76, 160, 84), (17, "Depreciation", 14, 7, 15, 8), (42, "Interest, group", 1, 0, 1, 0), (44, "Interest, other", 4, 2, 5, 3), (76, "Owners of the parent", 13, 7, 18, 9)],
    " cf_d ": [(14, "From operations", 21, 26), (22, "For equipment", -6, -9)],
    "CF_I": [(20, "From operations", 0, 0)],
}


def half_year(path):
    """Writes PORT. By hand: debt 70+20+5+25 = 120, net 120-31 = 89; sales 180; EBIT 190-160 = 30, EBITDA 45; free cash flow 26-9 = 17; interest 6."""
    # where the form has its labels and answers
    asked = {(4, 1): "Reporting period:", (6, 2): "Year:", (8, 2): "Quarter:", (19, 1): "Name of the issuer:", (31, 1): "Consolidated report:", (33, 1): "Audited:"}
    said = {(4, 5): dt.date(2024, 1, 1), (4, 8): dt.date(2024, 6, 30), (6, 5): 2024, (8, 5): "2.", (19, 3): "Luka Primjer d.d.", (31, 3): "KD", (33, 3): "RN"}
    sheets = {"General data": asked | said}
    for name, rows in PORT.items():
        cells = {(1, 1): name, (3, 1): "in EUR", (5, 7): "ADP code", (7, 1): "1", (7, 7): 2}
        for at, (code, label, *values) in enumerate(rows, start=9):
            cells |= {(at, 1): label, (at, 7): code} | {(at, 8 + k): v for k, v in enumerate(values)}
        sheets[name] = cells
    write(path, sheets | {"Notes": {}})
