import io
import zipfile

from attesta.operators import audit
from attesta.sources import office

S = "xmlns='urn:s' xmlns:r='urn:r'"


def workbook(sheets, names="", tables=(), order=""):
    """``sheets``: name -> (cells, table relationship ids); ``tables``: id -> (display name, range, columns), None if its part is lost."""
    out = io.BytesIO()
    rels = lambda pairs: "<Relationships>" + "".join(f"<Relationship Id='{i}' Target='{t}'/>" for i, t in pairs) + "</Relationships>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {S}><sheets>" + "".join(f"<sheet name='{n}' sheetId='{i}' r:id='r{i}'/>" for i, n in enumerate(sheets, 1)) + f"</sheets><definedNames>{names}</definedNames></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", rels((f"r{i}", f"worksheets/s{i}.xml") for i, _ in enumerate(sheets, 1)))
        for i, (cells, ids) in enumerate(sheets.values(), 1):
            parts = "".join(f"<tablePart r:id='{t}'/>" for t in ids)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {S}><sheetData>{cells}</sheetData><tableParts>{parts}</tableParts></worksheet>")
            z.writestr(f"xl/worksheets/_rels/s{i}.xml.rels", rels((t, f"../tables/{t}.xml") for t in ids))
        for t, spec in dict(tables).items():
            if spec:
                name, ref, columns = spec
                z.writestr(f"xl/tables/{t}.xml", f"<table {S} displayName='{name}' ref='{ref}'>" + "".join(f"<tableColumn name='{c}'/>" for c in columns) + "</table>")
    return out.getvalue()


def text(ref, value):
    return f"<c r='{ref}' t='inlineStr'><is><t>{value}</t></is></c>"


def test_what_workbooks_lean_on(spark, tmp_path):
    cells = text("B2", "Id") + text("C2", "Dose ") + "<c r='A9'><f>SUM('My data'!A1)+Gone!B2</f><v>1</v></c><c r='A10'><f>[1]Other!A1</f><v>1</v></c><c r='A11'><f>INDIRECT(A1)</f><v>1</v></c>"
    names = "<definedName name='ok'>'My data'!$A$1</definedName><definedName name='bad'>#REF!$A$1</definedName><definedName name='OK'>S1!A1</definedName><definedName name='ok' localSheetId='0'>S1!A1</definedName>"
    tables = {"t1": ("Doses", "B2:C5", ["Id", "Dose"]), "t2": ("Wrong", "B2:D5", ["Id", "Amount"]), "t3": None, "t4": ("Odd", "B2", ["Id"])}
    (tmp_path / "w.xlsx").write_bytes(workbook({"S1": (cells, ["t1", "t2", "t3", "t4"]), "My data": ("", []), "s1": ("", [])}, names, tables.items()))
    (tmp_path / "fine.xlsx").write_bytes(workbook({"S1": (text("B2", "Id") + text("C2", "dose"), ["t1"])}, "", [("t1", ("Doses", "B2:C5", ["Id", "Dose"]))]))
    parts, cells = office.read_parts(spark, f"{tmp_path}/*.xlsx"), office.read_cells(spark, f"{tmp_path}/*.xlsx")
    assert [(r.kind, r.name, r.sheet, r.text, r.columns) for r in parts.where("path like '%fine%'").collect()] == [("sheet", "S1", None, "xl/worksheets/s1.xml", []), ("table", "Doses", "S1", "B2:C5", ["Id", "Dose"])]
    got = {(r.severity, r.code, r.detail) for r in audit.audit_workbooks(parts, cells).collect()}
    assert got == {
        ("blocker", "repeated_name", "w.xlsx!sheet!s1"), ("blocker", "repeated_name", "w.xlsx!name!ok"), ("blocker", "lost_table_part", "w.xlsx!S1!t3"), ("blocker", "lost_reference", "w.xlsx!bad"),
        ("blocker", "external_reference", "w.xlsx!S1!R10C1"), ("unverified", "computed_reference", "w.xlsx!S1!R11C1"), ("blocker", "unknown_sheet", "w.xlsx!S1!R9C1!Gone"),
        ("blocker", "table_range", "w.xlsx!Odd!B2"), ("blocker", "table_width", "w.xlsx!Wrong"), ("blocker", "table_header", "w.xlsx!Wrong!Amount"),
    }
