import csv
import gzip
import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from attesta.sources import delimited, lines, manifest, office, sql_dump


def test_delimited_lines_headers_and_padding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿# note\nid,name,note\n1,\"two\nlines\",x\n2,b\n".encode())
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress(b"id\tname\n7\tz\n"))
    rows = {(r.path.rpartition("/")[2], r.row): r.record for r in delimited.read_delimited(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.tsv.gz"]).collect()}
    assert rows[("a.csv", 4)] == {"id": "1", "name": "two\nlines", "note": "x"} and rows[("a.csv", 5)]["note"] == ""
    assert rows[("b.tsv.gz", 2)] == {"id": "7", "name": "z"}
    for k, bad in enumerate((b"a,a\n1,2\n", b"a,\n1,2\n", b"a\n1,2\n")):
        (tmp_path / f"bad{k}.csv").write_bytes(bad)
        with pytest.raises((PySparkException, Py4JError)):
            delimited.read_delimited(spark, f"{tmp_path}/bad{k}.csv").collect()
    (tmp_path / "c.pdf").write_bytes(b"a\n1\n")
    with pytest.raises((PySparkException, Py4JError)):
        delimited.read_delimited(spark, f"{tmp_path}/c.pdf").collect()


def one_task(data, delimiter):
    """The same files, read from their start by the standard library."""
    reader = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), delimiter=delimiter)
    header = None
    for row in reader:
        if header is None:
            if any(c.strip() for c in row) and (not row[0].startswith("#") or row[0].strip() == "# Formula"):
                header = ["Formula" if c.strip() == "# Formula" else c.strip() for c in row]
        elif row:
            yield reader.line_num, dict(zip(header, row + [""] * (len(header) - len(row)), strict=True))


def test_delimited_in_many_splits_is_as_in_one_task(spark, tmp_path):
    r = random.Random(8)
    cell = lambda: r.choice(["", "x", "5\" pipe", '"a,b"', '"two\nlines"', '"say ""so"""', '"\n\n,\n"', '""', '"open"shut', "é" * r.randint(1, 30), '"' + "long\n" * r.randint(1, 400) + '"'])
    files = {}
    for k in range(4):
        end = "\r\n" if k == 2 else "\n"
        rows = [",".join(cell() for _ in range(r.randint(1, 3))) for _ in range(300)]
        files[f"f{k}.csv"] = ("\ufeff" * (k == 1) + "# c\n\na,b,c" + end + end.join(rows) + end * r.randint(0, 2)).encode()
    files["formula.csv"] = b"# Formula,RT\nx,1\n"
    files["open.csv"] = b'a,b\n1,"never\nclosed'
    files["blank.csv"] = b"\n\n"
    files["none.csv"] = b""
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {(n, line): rec for n, data in files.items() for line, rec in one_task(data, ",")}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "9000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = delimited.read_delimited(spark, f"{tmp_path}/*.csv").collect()
            assert len(got) == len(want) and {(x.path.rpartition("/")[2], x.row): x.record for x in got} == want
            numbered = sorted((x.row, x.value) for x in lines.numbered_lines(spark, f"{tmp_path}/f0.csv").collect())
            assert numbered == list(enumerate(files["f0.csv"].decode().removesuffix("\n").split("\n"), 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text('",ab', max_size=8), max_size=6))
def test_open_quotes(parts):
    """A quote is open after a line if the next line goes on with the same record."""
    records = lambda x: len(list(csv.reader(io.StringIO("\n".join(x) + "\n", newline="")))) if x else 0
    inside = False
    for p in parts:
        inside = lines.open_after(p, ",", inside)
    assert inside == (records([*parts, "x"]) == records(parts))


def test_strict_json(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n\n{"b": "NaN is text"}\n')
    assert delimited.strict_json(spark, f"{tmp_path}/ok.jsonl").count() == 2
    for k, bad in enumerate(['{"a":1,"a":2}', '{"a": NaN}', "{"]):
        (tmp_path / f"bad{k}.jsonl").write_text(bad + "\n")
        with pytest.raises((PySparkException, Py4JError)):
            delimited.strict_json(spark, f"{tmp_path}/bad{k}.jsonl").collect()
    assert [r.value is None for r in delimited.tolerant_json(spark, f"{tmp_path}/bad2.jsonl").collect()] == [True]


def test_dump_values_places_and_hashes(spark, tmp_path):
    (tmp_path / "d.sql").write_text(
        "-- a dump; with a comment\n/*!40101 SET NAMES utf8 */;\nDROP TABLE IF EXISTS `a`;\nCREATE TABLE `a` (`id` int, `body` text, PRIMARY KEY (`id`)) ENGINE=x;\n"
        "CREATE TABLE `empty` (`x` varchar(9));\nINSERT INTO `a` (`body`,`id`) VALUES ('x, y; ''q'' \\n(z)',1.20e+2),(NULL,-1);\nINSERT INTO `a` VALUES (3,'NULL');\n"
    )
    tables, rows = sql_dump.read_dump(spark, f"{tmp_path}/d.sql")
    assert {t: d.columns for t, d in tables.items()} == {"a": ["id", "body"], "empty": ["x"]}
    got = sorted((r.statement, r.tuple, r.body["id"], r.body["body"]) for r in rows.collect())
    assert [(t, i, b) for _, t, i, b in got] == [(1, "1.20e+2", "x, y; 'q' \n(z)"), (2, "-1", None), (1, "3", "NULL")]
    assert got[0][0] == got[1][0] < got[2][0]
    digest = sql_dump.table_digests(rows).collect()
    assert [(r.table_name, r.n) for r in digest] == [("a", 3)]


def test_dump_statements_end_where_they_end(spark, tmp_path):
    """Two statements on a line, other line ends, and semicolons in strings, comments and names; read in small splits."""
    body = (
        "CREATE TABLE `a` (`id` int, `b;c` text);CREATE TABLE `t` (`x` int);\r\n/* one; 'two */ INSERT INTO `a` VALUES (1,'a;\nb\\%c\\_d');\n-- don't;\n"
        "INSERT INTO `a` VALUES (2,'it''s \\\\');# it's; \nINSERT INTO `t`\nVALUES (1),\n(2) ;INSERT INTO `t` VALUES (3); \n" + "".join(f"INSERT INTO `a` VALUES ({i},'{'x;' * (i % 40)}\n;');\n" for i in range(3, 400))
    )
    (tmp_path / "d.sql").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            tables, rows = sql_dump.read_dump(spark, f"{tmp_path}/d.sql")
            got = {(r.table_name, r.body.get("id") or r.body.get("x")): r for r in rows.collect()}
            assert {t: d.columns for t, d in tables.items()} == {"a": ["id", "b;c"], "t": ["x"]}
            assert got["a", "1"].body["b;c"] == "a;\nb\\%c\\_d" and got["a", "2"].body["b;c"] == "it's \\"
            assert [got["t", str(k)].tuple for k in (1, 2, 3)] == [1, 2, 1] and len(got) == 402
            assert all(got["a", str(i)].body["b;c"] == "x;" * (i % 40) + "\n;" for i in range(3, 400))
            assert sorted(range(3, 400), key=lambda i: got["a", str(i)].statement) == list(range(3, 400))
            some = sql_dump.read_dump(spark, f"{tmp_path}/d.sql", where={"a": ("id", ["7", "9", "none"]), "t": ("x", ["2"])})[1].collect()
            assert {(r.table_name, r.tuple) for r in some} == {("a", 1), ("t", 2)} and len(some) == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for bad in ("SET x=1;\nINSERT INTO `a` VALUES (1,'x')", "/* never", "CREATE TABLE `a` (`id` int)", "INSERT INTO `a` VALUES (1,1,1);"):
        (tmp_path / "bad.sql").write_text("CREATE TABLE `a` (`id` int, `b` text);\n" + bad)
        with pytest.raises((PySparkException, sql_dump.SourceError)):
            sql_dump.read_dump(spark, f"{tmp_path}/bad.sql")[1].collect()


@pytest.mark.parametrize("text", ["UPDATE `a` SET id=1;\n", "INSERT INTO `a` VALUES (1);\n", "INSERT INTO `a` VALUES (now(),2);\n", "INSERT INTO `a` (`id`,`id`) VALUES (1,2);\n", "INSERT INTO `a` VALUES (1,'x;\n", "DROP TABLE `a`;\n", "INSERT INTO `zzz` VALUES (1);\n", "INSERT INTO `a` VALUES (1,2),;\n"])
def test_dump_fails_closed(spark, tmp_path, text):
    (tmp_path / "d.sql").write_text("CREATE TABLE `a` (`id` int, `body` text);\n" + text)
    with pytest.raises((PySparkException, sql_dump.SourceError)):
        sql_dump.read_dump(spark, f"{tmp_path}/d.sql")[1].collect()


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets>" + "".join(f"<sheet name='{n}' r:id='r{i}'/>" for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f"<Relationship Id='r{i}' Target='worksheets/s{i}.xml'/>" for i in range(len(sheets))) + "</R>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Model</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        for i, cells in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>")
    return out.getvalue()


def test_workbook_cells_and_tables(spark, tmp_path):
    cells = (
        "<c r='A1' t='inlineStr'><is><t>Model  values</t></is></c><c r='A2' t='s'><v>0</v></c><c r='B2' t='inlineStr'><is><t>Effect</t></is></c>"
        "<c r='A3' t='s'><v>1</v></c><c r='B3'><v>1.5</v></c><c r='A4'><v>x</v></c><c r='AA4' t='b'><v>1</v></c><c r='A6'><v>later</v></c><c r='B3x'/>"
    )
    (tmp_path / "w.xlsx").write_bytes(workbook({"S": cells, "T": "<c r='B1'><v>h</v></c><c r='A2'><v>9</v></c><c r='B2'><f>A2*2</f><v>18</v></c>"}))
    got = office.read_cells(spark, f"{tmp_path}/w.xlsx")
    flat = {(r.sheet, r.row, r.col): (r.text, r.formula) for r in got.collect()}
    assert flat[("S", 3, 1)] == ("ab", None) and flat[("S", 4, 27)] == ("TRUE", None) and flat[("T", 2, 2)] == ("18", "A2*2")
    rows = {r.row: r.record for r in office.marked_tables(got, "model values").collect()}
    assert rows == {3: {"Model": "ab", "Effect": "1.5"}, 4: {"Model": "x", "Effect": ""}}
    assert {r.sheet: r.record for r in office.sheet_rows(got.where("sheet = 'T'")).collect()} == {"T": {"__native_index": "9", "h": "18"}}


def test_zipped_xml_and_documents(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in/h.xml", "<hsdb><DOC><NO>1</NO><t>a</t><t>b <i>c</i></t></DOC><DOC/></hsdb>")
    (tmp_path / "h.zip").write_bytes(out.getvalue())
    got = office.read_xml_records(spark, f"{tmp_path}/h.zip", ".xml", "DOC").collect()
    assert sorted(((r.record, r.position, r.tag, r.ordinal, r.text) for r in got), key=str) == [(1, 0, "NO", 1, "1"), (1, 1, "t", 1, "a"), (1, 2, "t", 2, "b c"), (2, None, None, None, None)]
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", "<d xmlns:w='w'><w:p><w:pPr><w:pStyle w:val='Caption'/></w:pPr><w:r><w:t>Figure 1. x</w:t></w:r></w:p><w:p><w:r><w:blip/></w:r></w:p></d>")
    (tmp_path / "d.docx").write_bytes(doc.getvalue())
    assert [(r.block, r.style, r.text, r.images) for r in office.read_blocks(spark, f"{tmp_path}/d.docx").collect()] == [(0, "Caption", "Figure 1. x", 0), (1, "", "", 1)]
    with pytest.raises(delimited.SourceError):
        office.safe_member("../x")


def test_inventory_and_checksums(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("x")
    inv = manifest.inventory(spark, f"{tmp_path}/f").collect()
    assert [(r.bytes, r.format) for r in inv] == [(1, "csv")]
    h = inv[0].sha256
    (tmp_path / "sums").write_text(f"# c\n{h}  a.csv\nSHA256 (./b.csv) = {h.upper()}\nnonsense\n{h} *../up\n{h}  a.csv\n")
    got = [(r.line, r.path, r.problem) for r in manifest.checksums(spark, f"{tmp_path}/sums").orderBy("line").collect()]
    assert got == [(2, "a.csv", None), (3, "b.csv", None), (4, None, "malformed_line"), (5, "../up", "unsafe_path"), (6, "a.csv", "duplicate_path")]
    (tmp_path / "sums.json").write_text('{"algorithm":"sha256","files":[{"path":"a","sha256":"zz"}]}')
    assert [r.problem for r in manifest.checksums(spark, f"{tmp_path}/sums.json").collect()] == ["invalid_checksum"]


def test_collect_registers_everything(spark, tmp_path):
    from attesta.sources.collect import collect, repeated_names

    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.csv").write_text("id,v\n1,x\n2,y\n")
    (tmp_path / "d" / "sub" / "A.csv").write_text("id\n")
    (tmp_path / "d" / "b.jsonl").write_text('{"k": 1}\n')
    (tmp_path / "d" / "w.xlsx").write_bytes(workbook({"T": "<c r='A1'><v>h</v></c><c r='A2'><v>9</v></c>"}))
    (tmp_path / "d" / "x.bin").write_bytes(b"?")
    got = collect(spark, f"{tmp_path}/d")
    name = lambda p: p.rpartition("/")[2]
    assert {name(r.path): (r.status, r.rows) for r in got.registry.collect()} == {"a.csv": ("read", 2), "A.csv": ("read", None), "b.jsonl": ("read", 1), "w.xlsx": ("read", 1), "x.bin": ("unsupported", None)}
    assert {name(r.path): r.reason for r in got.gaps.collect()} == {"A.csv": "no_rows", "x.bin": "unsupported_format"}
    assert sorted((r.sheet, str(sorted(r.record.items()))) for r in got.records.where("path like '%w.xlsx' or path like '%b.jsonl'").collect()) == [("", "[('k', '1')]"), ("T", "[('h', '9')]")]
    assert [r.name for r in repeated_names(got.registry).collect()] == ["a.csv"]


def test_a_long_statement_comes_in_pieces():
    from attesta.sources import sql_dump

    seen = []
    found = (seen.append(k) or (k, v) for k, v in sql_dump.tuples(",".join(f"({i},'x')" for i in range(9001))))
    frames = sql_dump.framed("t", 1, ["a", "b"], found)
    assert len(next(frames)) == len(seen) == sql_dump.PIECE
    assert sum(map(len, frames)) == 9001 - sql_dump.PIECE and seen == list(range(1, 9002))
