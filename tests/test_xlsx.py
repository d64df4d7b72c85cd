"""Workbooks made by hand, part by part."""

from __future__ import annotations

import zipfile

import pytest

from docquarry.operators import tables
from docquarry.sources import xlsx

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, shared=(), formats=(), date1904=False, styles=(0,)):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Type="{REL}/{kind}" Target="{"/xl/" if k % 2 else ""}sheets/s{k}.xml"/>' for k, (_, kind, _) in enumerate(sheets, 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts>' + "".join(f'<numFmt numFmtId="{k}" formatCode="{c}"/>' for k, c in formats) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{k}"/>' for k in styles) + "</cellXfs></styleSheet>")
        for k, (_, _, body) in enumerate(sheets, 1):
            z.writestr(f"xl/sheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


def test_cells_of_every_kind(spark, tmp_path):
    body = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in  line</t></is></c></row>'
            '<row r="4"><c r="A4"><v>3</v></c><c r="B4"><v>3.50</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="e"><v>#N/A</v></c><c r="E4" t="str"><f>A1</f><v>made</v></c><c r="F4" s="1"><v>45000.5</v></c><c r="G4" s="2"><v>0.25</v></c><c r="H4" s="3"><v>7</v></c><c r="AA4"><v>1E3</v></c></row>'
            "<row><c><v>9</v></c><c/></row>")
    workbook(tmp_path / "a.xlsx", [("One", "worksheet", body), ("Chart", "chartsheet", ""), ("Two &amp; more", "worksheet", '<row r="2"><c r="B2" s="1"><v>1</v></c></row>')],
             ["<t> sh</t>", ""], [(164, "dd/mm/yyyy"), (165, '0.0&quot; days&quot;')], styles=(0, 164, 20, 165))
    got = {(r["sheet"], r["physical"]): r["cells"] for r in xlsx.read_xlsx(spark, f"file:{tmp_path}").collect()}
    assert got["One", 1] == ["sh", "", "in line"] and got["One", 5] == ["9", ""]
    assert got["One", 4][:8] == ["3", "3.5", "True", "#N/A", "made", "2023-03-15 12:00:00", "06:00:00", "7"] and got["One", 4][26] == "1000.0" and len(got["One", 4]) == 27
    assert got["Two & more", 2] == ["", "1900-01-01 00:00:00"] and len(got) == 4


def test_rich_strings_and_other_epochs(spark, tmp_path):
    workbook(tmp_path / "b.xlsx", [("S", "worksheet", '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="0"><v>1</v></c></row>')], ["<r><t>a</t></r><r><t>b</t></r><rPh><t>no</t></rPh>"], date1904=True, styles=(14,))
    assert [r["cells"] for r in xlsx.read_xlsx(spark, f"file:{tmp_path}").collect()] == [["ab", "1904-01-02 00:00:00"]]


def test_sheets_are_built_from_workbooks(spark, tmp_path):
    cells = lambda n, *values: f'<row r="{n}">' + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(values) if v) + "</row>"
    body = cells(2, "Name", "City", "City") + cells(3, "", "", "") + cells(5, "Ana", "", "Natal") + cells(6, "Rui", "Fortaleza")
    for name in ("x", "y"):
        workbook(tmp_path / f"{name}.xlsx", [("People", "worksheet", body), ("Nothing", "worksheet", "")])
    rows = xlsx.sheets(xlsx.read_xlsx(spark, f"file:{tmp_path}"))
    got = sorted((r["sheet"][-len("x.xlsx#People"):], r["row_number"], sorted(r["row_values"].items())) for r in tables.build_sheet(rows).collect())
    assert got == [(f"{n}.xlsx#People", k, v) for n in "xy" for k, v in ((2, [("City_2", "Natal"), ("Name", "Ana")]), (3, [("City", "Fortaleza"), ("Name", "Rui")]))]


def test_what_is_no_workbook_stops(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_text("no archive")
    with pytest.raises(Exception, match="zip"):
        xlsx.read_xlsx(spark, f"file:{tmp_path}").collect()
