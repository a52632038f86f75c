"""Workbooks and documents in zipped XML, read with the standard library inside tasks, a file each."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from posixpath import dirname, normpath
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.delimited import SourceError

_REF = re.compile(r"([A-Z]+)(\d+)")


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def safe_member(name: str) -> str:
    """A member's path inside its archive; absolute and escaping paths fail."""
    path = normpath(name.replace("\\", "/"))
    if path.startswith(("/", "..")) or ":" in path:
        raise SourceError(f"unsafe member {name!r}")
    return path


def opened(data: bytes) -> zipfile.ZipFile:
    """An archive without repeated or unsafe members."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = [safe_member(n) for n in z.namelist()]
    if len(set(names)) < len(names):
        raise SourceError("an archive has repeated members")
    return z


def related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id, as member paths."""
    rels = f"{dirname(part)}/_rels/{part.rpartition('/')[2]}.rels".lstrip("/")
    if rels not in z.namelist():
        return {}
    base = dirname(part)
    return {r.get("Id"): r.get("Target").lstrip("/") if r.get("Target").startswith("/") else normpath(f"{base}/{r.get('Target')}") for r in ET.fromstring(z.read(rels)) if r.get("TargetMode") != "External"}


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str, str | None]]:
    """``(sheet, row, column, text, formula)`` of each cell that has one, shared and inline strings resolved."""
    z = opened(data)
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter() if _name(t) == "t") for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    targets = related(z, "xl/workbook.xml")
    for sheet in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _name(e) == "sheet"):
        part = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        for c in (e for e in ET.fromstring(z.read(part)).iter() if _name(e) == "c"):
            m = _REF.match(c.get("r", ""))
            kids = {_name(x): x for x in c}
            raw, kind = kids["v"].text or "" if "v" in kids else "", c.get("t")
            text = "".join(t.text or "" for t in c.iter() if _name(t) == "t") if kind == "inlineStr" else shared[int(raw)] if kind == "s" and raw else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else raw
            formula = kids["f"].text or "" if "f" in kids else None
            if m and (text or formula is not None):
                yield sheet.get("name"), int(m.group(2)), column_number(m.group(1)), text, formula


def workbook_parts(data: bytes) -> Iterator[tuple[str, str, str | None, str, list[str]]]:
    """``(kind, name, sheet, text, columns)`` of a workbook's sheets, defined names and tables.

    ``text`` is a name's formula or a table's range; a name that holds in one sheet only has that sheet. A table part that no
    relationship leads to is a ``lost_table``.
    """
    z = opened(data)
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = related(z, "xl/workbook.xml")
    sheets = [(e.get("name", ""), targets.get(_attribute(e, "id"), "")) for e in book.iter() if _name(e) == "sheet"]
    for name, part in sheets:
        yield "sheet", name, None, part, []
    for e in (x for x in book.iter() if _name(x) == "definedName"):
        at = e.get("localSheetId")
        yield "name", e.get("name", ""), None if at is None else sheets[int(at)][0] if int(at) < len(sheets) else "", e.text or "", []
    for name, part in sheets:
        if part not in z.namelist():
            continue
        parts = related(z, part)
        for e in (x for x in ET.fromstring(z.read(part)).iter() if _name(x) == "tablePart"):
            target = parts.get(_attribute(e, "id"), "")
            if target not in z.namelist():
                yield "lost_table", _attribute(e, "id"), name, target, []
                continue
            root = ET.fromstring(z.read(target))
            yield "table", root.get("displayName") or root.get("name", ""), name, root.get("ref", ""), [c.get("name", "") for c in root.iter() if _name(c) == "tableColumn"]


def _own(e: ET.Element, *path: str) -> ET.Element | None:
    """A descendant by the local names on the way to it."""
    for name in path:
        e = next((x for x in e if _name(x) == name), None) if e is not None else None
    return e


def _val(e: ET.Element | None, default: str = "") -> str:
    return default if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "val"), default)


def _attribute(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def written(n: int, form: str) -> str:
    """A counter in one of the forms that lists have; digits for any other."""
    if form in ("lowerLetter", "upperLetter") and n > 0:
        letter = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)
        return letter if form == "lowerLetter" else letter.upper()
    if form in ("lowerRoman", "upperRoman") and n > 0:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + sign * (n // value), n % value
        return out if form == "lowerRoman" else out.upper()
    return "" if form == "none" else f"{n:02d}" if form == "decimalZero" else str(n)


class Numbering:
    """The lists of a document, and how far each of them has counted.

    A list is counted by its abstract definition, whichever of its instances a paragraph names; an instance that
    sets a start anew does so at its first paragraph. A paragraph of a level counts that level up and lets the deeper ones
    start again, but for those that restart only after another level, or never.
    """

    def __init__(self, part: ET.Element | None, styles: ET.Element | None):
        self.levels: dict[str, dict[int, dict]] = {}
        self.instances: dict[str, tuple[str, dict[int, int]]] = {}
        self.by_style: dict[str, tuple[str, int]] = {}
        self.counts: dict[str, dict[int, int]] = {}
        self.begun: set[tuple[str, int]] = set()
        for e in part if part is not None else ():
            if _name(e) == "abstractNum":
                self.levels[_attribute(e, "abstractNumId")] = {int(_attribute(x, "ilvl")): self._level(x) for x in e if _name(x) == "lvl"}
            elif _name(e) == "num":
                starts = {int(_attribute(x, "ilvl")): int(_val(_own(x, "startOverride"))) for x in e if _name(x) == "lvlOverride" and _own(x, "startOverride") is not None}
                self.instances[_attribute(e, "numId")] = _val(_own(e, "abstractNumId")), starts
        for e in styles if styles is not None else ():
            if _name(e) == "style" and (of := _own(e, "pPr", "numPr")) is not None:
                self.by_style[_attribute(e, "styleId")] = _val(_own(of, "numId")), int(_val(_own(of, "ilvl"), "0"))

    @staticmethod
    def _level(e: ET.Element) -> dict:
        restart = _val(_own(e, "lvlRestart"))
        return {"start": int(_val(_own(e, "start"), "1")), "form": _val(_own(e, "numFmt"), "decimal"), "text": _val(_own(e, "lvlText")), "restart": int(restart) if restart else None}

    def label(self, paragraph: ET.Element, style: str) -> tuple[int | None, str | None]:
        """``(level, label)`` of the next paragraph in order; nulls if it is in no list."""
        direct = _own(paragraph, "pPr", "numPr")
        number, level = self.by_style.get(style, ("", 0))
        if direct is not None:
            number = _val(_own(direct, "numId"), number)
            level = int(_val(_own(direct, "ilvl"), str(level)))
        abstract, starts = self.instances.get(number, ("", {}))
        levels = self.levels.get(abstract, {})
        if level not in levels:
            return None, None
        counts = self.counts.setdefault(abstract, {})
        for k in [k for k in starts if (number, k) not in self.begun and k <= level]:
            self.begun.add((number, k))
            counts.pop(k, None)
            if k == level:
                counts[k] = starts[k] - 1
        counts[level] = counts.get(level, levels[level]["start"] - 1) + 1
        for k in list(counts):
            after = levels[k]["restart"] if k in levels else None
            if k > level and (after is None or (after and level < after)):
                del counts[k]
        if levels[level]["form"] == "bullet":
            return level, levels[level]["text"]
        text = levels[level]["text"]
        for k in sorted(levels, reverse=True):
            if f"%{k + 1}" in text:
                text = text.replace(f"%{k + 1}", written(counts.get(k, levels[k]["start"]), levels[k]["form"]))
        return level, text


def document_blocks(data: bytes) -> Iterator[tuple[int, str, str, int, int | None, str | None]]:
    """``(block, style, text, images, level, label)`` of each paragraph of a document body, in order; the last two of those in lists."""
    z = opened(data)
    part = lambda name: ET.fromstring(z.read(name)) if name in z.namelist() else None
    lists = Numbering(part("word/numbering.xml"), part("word/styles.xml"))
    for n, p in enumerate(e for e in part("word/document.xml").iter() if _name(e) == "p"):
        style = next((next(iter(s.attrib.values()), "") for s in p.iter() if _name(s) == "pStyle"), "")
        text = "".join((e.text or "") if _name(e) == "t" else "\t" if _name(e) == "tab" else "\n" if _name(e) == "br" else "" for e in p.iter())
        yield n, style, text, sum(_name(e) == "blip" for e in p.iter()), *lists.label(p, style)


def xml_records(data: bytes, suffix: str, tag: str) -> Iterator[tuple[str, int, list[tuple[str, str]]]]:
    """``(member, ordinal, fields)``: child elements in order of each ``tag`` in a zip's matching members."""
    z = opened(data)
    if bad := z.testzip():
        raise SourceError(f"damaged member {bad}")
    for member in sorted(n for n in z.namelist() if n.endswith(suffix)):
        n = 0
        for _, e in ET.iterparse(z.open(member)):
            if _name(e) == tag:
                n += 1
                yield member, n, [(_name(x), "".join(x.itertext()).strip()) for x in e]
                e.clear()


def _files(spark: SparkSession, path: str | list[str], schema: str, rows: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    names = ["path", *[f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                held = []
                for r in rows(bytes(data)):
                    held.append((p, *r))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All cells of the workbooks under ``path``: ``path, sheet, row, col, text, formula``."""
    return _files(spark, path, "sheet string, row int, col int, text string, formula string", workbook_cells)


def read_parts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All sheets, defined names and tables of the workbooks under ``path``: ``path, kind, name, sheet, text, columns``."""
    return _files(spark, path, "kind string, name string, sheet string, text string, columns array<string>", workbook_parts)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """All paragraphs of the documents under ``path``: ``path, block, style, text, images, level, label``; the last two for list items."""
    return _files(spark, path, "block int, style string, text string, images int, level int, label string", document_blocks)


def read_xml_records(spark: SparkSession, path: str, suffix: str, tag: str) -> DataFrame:
    """Records of zipped XML as one row for each field: ``path, member, record, position, tag, ordinal, text``.

    A record without fields gives one row with nulls.
    """
    from pyspark.sql.window import Window

    got = _files(spark, path, "member string, record int, fields array<struct<tag:string,text:string>>", lambda d: ((m, n, [{"tag": a, "text": b} for a, b in f]) for m, n, f in xml_records(d, suffix, tag)))
    long = got.select("path", "member", "record", F.posexplode_outer("fields").alias("position", "f")).select("path", "member", "record", "position", "f.tag", "f.text")
    w = Window.partitionBy("path", "member", "record", "tag").orderBy("position")
    return long.withColumn("ordinal", F.when(F.col("tag").isNotNull(), F.row_number().over(w)))


def sheet_rows(cells: DataFrame, header_row: int = 1, required: tuple[str, ...] = ()) -> DataFrame:
    """``path, sheet, row, record``: rows under a header row; a blank first header is ``__native_index``.

    A sheet whose header lacks a ``required`` column, or names a column twice, fails.
    """
    head = cells.where(F.col("row") == header_row).select("path", "sheet", "col", F.btrim("text").alias("name"))
    first = cells.groupBy("path", "sheet").agg(F.lit(1).alias("col")).select("path", "sheet", "col", F.lit("__native_index").alias("name"))
    head = head.unionByName(first.join(head, ["path", "sheet", "col"], "left_anti"))
    names = head.groupBy("path", "sheet").agg(F.collect_set("name").alias("names"), F.count("*").alias("n"))
    lost = F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), "names")
    why = F.when(F.size(lost) > 0, F.concat(F.lit("lacks "), F.array_join(lost, ", "))).when(F.size("names") < F.col("n"), "names a column twice")
    sound = names.select("path", "sheet", F.when(why.isNotNull(), F.raise_error(F.concat("path", F.lit(" "), "sheet", F.lit(": header "), why)).cast("boolean")).otherwise(True).alias("sound"))
    cells = cells.join(sound, ["path", "sheet"]).where("sound").drop("sound")
    body = cells.where(F.col("row") > header_row).join(head, ["path", "sheet", "col"])
    return body.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("record"))


def keyed_rows(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, keys)`` of sheet rows: ``rows`` with ``key``, the trimmed value of a column, those without one left out; ``key, n``, how many have it."""
    keyed = rows.withColumn("key", F.btrim(F.col("record")[column])).where("key <> ''")
    return keyed, keyed.groupBy("key").agg(F.count("*").alias("n"))


def marked_tables(cells: DataFrame, marker: str) -> DataFrame:
    """``path, sheet, row, record``: the table whose header follows a cell of that text, up to the first blank row."""
    folded = F.lower(F.btrim(F.regexp_replace("text", r"\s+", " ")))
    at = cells.where(folded == marker.lower()).groupBy("path", "sheet").agg(F.min("row").alias("m"))
    below = cells.join(at, ["path", "sheet"]).where("row > m")
    rows = below.groupBy("path", "sheet", "m", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "text")))).alias("cells"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("path", "sheet").orderBy("row")
    rows = rows.withColumn("gap", F.col("row") - F.row_number().over(w)).withColumn("head", F.first("gap").over(w)).where("gap = head")
    rows = rows.withColumn("names", F.first("cells").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1")
    entries = F.transform(F.map_entries("names"), lambda e: F.struct(e["value"].alias("key"), F.coalesce(F.col("cells")[e["key"]], F.lit("")).alias("value")))
    return rows.select("path", "sheet", "row", F.map_from_entries(entries).alias("record"))
