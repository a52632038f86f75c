import io
import zipfile

import pytest

from attesta.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def level(i, text, form="decimal", start=1, restart=None):
    again = "" if restart is None else f'<w:lvlRestart w:val="{restart}"/>'
    return f'<w:lvl w:ilvl="{i}"><w:start w:val="{start}"/><w:numFmt w:val="{form}"/>{again}<w:lvlText w:val="{text}"/></w:lvl>'


def document(lists, paragraphs, styles=""):
    """A document of ``(numId, level, text)`` paragraphs, or ``(style, None, text)``."""
    body = "".join(
        f'<w:p><w:pPr><w:pStyle w:val="{n}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if i is None else f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{i}"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
        for n, i, t in paragraphs
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f"<w:numbering {W}>{lists}</w:numbering>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return out.getvalue()


def labels(data):
    return [x[5] for x in office.document_blocks(data)]


NESTED = f'<w:abstractNum w:abstractNumId="0">{level(0, "%1.")}{level(1, "%1.%2", "lowerLetter")}{level(2, "(%3)", "upperRoman", 4)}</w:abstractNum>'
TWO = '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride></w:num>'


def test_nested_lists_restart_below_a_higher_level():
    at = [0, 1, 1, 2, 2, 1, 0, 1, 2, 0]
    assert labels(document(NESTED + TWO, [(1, i, "x") for i in at])) == ["1.", "1.a", "1.b", "(IV)", "(V)", "1.c", "2.", "2.a", "(IV)", "3."]


def test_an_instance_that_starts_anew_does_so_once():
    got = labels(document(NESTED + TWO, [(1, 0, "x"), (1, 0, "x"), (2, 0, "x"), (2, 0, "x"), (1, 0, "x"), (2, 1, "x")]))
    assert got == ["1.", "2.", "7.", "8.", "9.", "9.a"]


def test_levels_that_never_restart_or_only_after_another():
    never = f'<w:abstractNum w:abstractNumId="0">{level(0, "%1")}{level(1, "%2", restart=0)}{level(2, "%3", restart=1)}</w:abstractNum>'
    got = labels(document(never + TWO, [(1, 0, "x"), (1, 1, "x"), (1, 2, "x"), (1, 1, "x"), (1, 2, "x"), (1, 0, "x"), (1, 1, "x"), (1, 2, "x")]))
    assert got == ["1", "1", "1", "2", "2", "2", "3", "1"]


def test_styles_bullets_and_no_lists(spark, tmp_path):
    lists = f'{NESTED}<w:abstractNum w:abstractNumId="5">{level(0, "-", "bullet")}</w:abstractNum>{TWO}<w:num w:numId="3"><w:abstractNumId w:val="5"/></w:num>'
    styles = '<w:style w:styleId="Step"><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style>'
    data = document(lists, [("Step", None, "a"), ("Plain", None, "b"), (3, 0, "c"), (0, 0, "d"), (9, 0, "e"), ("Step", None, "f")], styles)
    (tmp_path / "d.docx").write_bytes(data)
    got = [(r.text, r.level, r.label) for r in office.read_blocks(spark, f"{tmp_path}/d.docx").orderBy("block").collect()]
    assert got == [("a", 1, "1.a"), ("b", None, None), ("c", 0, "-"), ("d", None, None), ("e", None, None), ("f", 1, "1.b")]


@pytest.mark.parametrize(("n", "form", "text"), [(27, "lowerLetter", "aa"), (53, "upperLetter", "AAA"), (1994, "upperRoman", "MCMXCIV"), (3, "decimalZero", "03"), (3, "none", ""), (3, "ordinal", "3")])
def test_counters(n, form, text):
    assert office.written(n, form) == text


def test_sheets_must_have_their_columns(spark):
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    cells = [("p", "s", 1, 1, "id"), ("p", "s", 1, 2, "v"), ("p", "s", 2, 1, " k "), ("p", "s", 2, 2, "1"), ("p", "s", 3, 1, "k"), ("p", "s", 4, 2, "9")]
    df = spark.createDataFrame(cells, "path string, sheet string, row int, col int, text string")
    rows, keys = office.keyed_rows(office.sheet_rows(df, required=("id", "v")), "id")
    assert [(r.row, r.key) for r in rows.orderBy("row").collect()] == [(2, "k"), (3, "k")] and [tuple(r) for r in keys.collect()] == [("k", 2)]
    for bad in (office.sheet_rows(df, required=("id", "w")), office.sheet_rows(df.union(df.where("row = 1 and col = 1").selectExpr("path", "sheet", "row", "3 as col", "text")))):
        with pytest.raises((PySparkException, Py4JError)):
            bad.collect()
