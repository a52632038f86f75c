"""Closure checks of documents, workbooks and bundles: facts are parsed, findings are anti-joins and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions.text import citations, column_index, label_references, leading_label, parameters
from attesta.functions.values import folded, is_close
from attesta.operators.evaluate import formula_references
from attesta.operators.joins import reconcile
from attesta.operators.ordered import running_sums
from attesta.plans.staging import Staging

SEVERITY = {"blocker": 3, "unverified": 2, "warning": 1}


def finding(rows: DataFrame, gate: str, severity: str, code: str, detail: str | Column) -> DataFrame:
    """``gate, severity, code, detail`` for each row."""
    d = F.col(detail) if isinstance(detail, str) else detail
    return rows.select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), d.cast("string").alias("detail"))


def gates(findings: DataFrame, names: list[str]) -> DataFrame:
    """``gate, status, n``: each gate's worst severity, ``pass`` without findings."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    worst = findings.groupBy("gate").agg(F.max(rank[F.col("severity")]).alias("w"), F.count("*").alias("n"))
    every = findings.sparkSession.createDataFrame([(g,) for g in names], "gate string").join(worst, "gate", "left")
    status = F.when(F.col("w") == 3, "fail").when(F.col("w") == 2, "unverified").when(F.col("w") == 1, "warn").otherwise("pass")
    return every.select("gate", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def gaps_and_repeats(labels: DataFrame, kind: str, number: str) -> DataFrame:
    """``kind, problem, number, upto``: numbers from 1 that are missing before the next one, and those there more than once.

    A gap is one line, from ``number`` to ``upto``, however wide; a number's neighbour is found in ranges of all numbers.
    """
    counted = Staging(labels.sparkSession, "gaps").put(labels.where(F.col(number).isNotNull()).groupBy(kind, F.col(number).cast("long").alias("number")).agg(F.count("*").alias("n")), "counted")
    ranked = running_sums(counted.withColumn("one", F.lit(1).cast("long")), [kind], [F.col("number")], {"place": "one"})
    before = ranked.select(kind, (F.col("place") + 1).alias("place"), F.col("number").alias("last"))
    gaps = ranked.join(before, [kind, "place"], "left").withColumn("first", F.coalesce("last", F.lit(0)) + 1).where(F.col("number") > F.col("first"))
    missing = gaps.select(kind, F.lit("missing").alias("problem"), F.col("first").alias("number"), (F.col("number") - 1).alias("upto"))
    return missing.unionByName(counted.where("n > 1").select(kind, F.lit("repeated").alias("problem"), "number", F.col("number").alias("upto")))


def audit_documents(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """Findings over ``path, block, text`` and a reference list ``number``.

    Citations of numbers without an entry, entries never cited, wrong brackets; figures and tables that are
    referred to without a caption, and captions that leave gaps or come twice.
    """
    key = F.concat_ws("#", "path", "block")
    text = blocks.select(key.alias("at"), "path", "text")
    cited = citations(text, "at", "text")
    numbers = cited.where("number is not null").select("number").distinct()
    text = text.withColumns({k: leading_label("text", k, caption=True) for k in ("figure", "table")})
    captions = text.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("figure", "table")]))).where("label is not null")
    found = [
        finding(numbers.join(references.select(F.col("number").cast("long").alias("number")), "number", "left_anti"), "bibliography", "blocker", "citation_without_entry", "number"),
        finding(references.select(F.col("number").cast("long").alias("number")).join(numbers, "number", "left_anti"), "bibliography", "warning", "entry_never_cited", "number"),
        finding(cited.where("problem is not null"), "bibliography", "blocker", "invalid_numeric_citation_range", F.concat_ws(":", "at", "problem")),
    ]
    for kind in ("figure", "table"):
        used = text.where("figure is null and table is null").select(F.explode(label_references("text", kind)).alias("label")).distinct()
        found.append(finding(used.join(captions.where(F.col("kind") == kind), "label", "left_anti"), "figure_table_references", "blocker", f"{kind}_without_caption", "label"))
    main = captions.where(~F.col("label").startswith("S")).select("kind", F.col("label").cast("long").alias("number"))
    loose = gaps_and_repeats(main, "kind", "number")
    found.append(finding(loose, "figure_table_references", "blocker", "caption_sequence", F.concat_ws(" ", "kind", F.concat("number", F.when(F.col("upto") > F.col("number"), F.concat(F.lit("-"), "upto")).otherwise("")), "problem")))
    return reduce(DataFrame.unionByName, found)


def audit_manifest(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Findings of a checksum list (``path, sha256, problem``) against an inventory (``path, sha256``)."""
    bad = finding(listed.where("problem is not null"), "manifest", "blocker", "manifest_entry", F.concat_ws(":", "line", "problem"))
    state = reconcile(listed.where("problem is null"), actual, "path", "sha256").where("status <> 'current'")
    return bad.unionByName(state.select(F.lit("manifest").alias("gate"), F.lit("blocker").alias("severity"), F.concat(F.col("status"), F.lit("_manifest_entry")).alias("code"), F.col("path").alias("detail")))


def validate_report(claimed: DataFrame, source: DataFrame, key: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """Findings of a report's table against its source: keys without regard to case, numbers within tolerance."""
    fold = lambda df, n: df.select(folded(key).alias("key"), F.struct(*[F.col(c).cast("string").alias(c) for c in [*numbers, *texts]]).alias(n))
    both = fold(claimed, "c").join(fold(source, "s"), "key", "full_outer")
    lone = both.where("c is null or s is null")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(c in numbers).alias("num"), F.col(f"c.{c}").alias("a"), F.col(f"s.{c}").alias("b")) for c in [*numbers, *texts]])
    lines = both.where("c is not null and s is not null").select("key", F.inline(cells))
    a, b = F.col("a").try_cast("double"), F.col("b").try_cast("double")
    same = F.when(F.col("num"), F.coalesce(is_close(a, b), F.lit(False))).otherwise(F.coalesce(folded("a") == folded("b"), F.lit(False)))
    wrong = finding(lines.where(~same), "report", "blocker", "value_mismatch", F.concat_ws(":", "key", "field"))
    return wrong.unionByName(finding(lone, "report", "blocker", "row_mismatch", "key"))


def not_rising(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows whose value does not exceed the one before, in table order."""
    w = Window.partitionBy(*keys).orderBy(order)
    flags = [F.when(F.col(c) <= F.lag(c).over(w), F.lit(c)) for c in columns]
    return rows.withColumn("stalled", F.array_compact(F.array(*flags))).where(F.size("stalled") > 0)


def ordinals(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with a number from 1 within each group, in the given order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def nearest_before(rows: DataFrame, keys: list[str], order: str, wanted: Column, reach: int, name: str) -> DataFrame:
    """``rows`` with the ``order`` of the nearest row before that is ``wanted``, at most ``reach`` rows back."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, -1)
    return rows.withColumn(name, F.max(F.when(wanted, F.col(order))).over(w))


def parameter_issues(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, issue`` of parameter lists."""
    return rows.select(key, F.explode(parameters(column)[1]).alias("issue"))


def single_unit(rows: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Groups that mix units."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(unit)).alias("units")).where(F.size("units") != 1)


def effective_styles(styles: DataFrame, properties: list[str]) -> DataFrame:
    """Each style's properties, a missing one from its nearest ancestor; ``styles`` has ``style, parent``.

    Each round goes twice as far up as all before, so the rounds number the logarithm of the deepest chain. Parents
    that form a cycle fail.
    """
    own = styles.select("style", F.col("parent").alias("up"), *properties)
    limit = max(2, styles.count()).bit_length() + 1
    stage = Staging(styles.sparkSession, "styles")
    for k in range(limit):
        above = own.select(F.col("style").alias("up"), F.col("up").alias("next"), *[F.col(p).alias(f"b_{p}") for p in properties])
        got = own.join(above, "up", "left").select("style", F.col("next").alias("up"), *[F.coalesce(p, f"b_{p}").alias(p) for p in properties])
        own = stage.put(got, f"round{k}")
        if own.where("up is not null").isEmpty():
            return own.drop("up")
    raise ValueError("style parents form a cycle")


def table_shapes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rows, columns, ragged, repeated_headers`` of tables given as cells (``row, column, text``, from 0).

    A repeated header is a later row whose cells are those of the first. Rows are compared by a hash of their cells in
    order, so only one short text a row is gathered.
    """
    lines = cells.groupBy(*keys, "row").agg(F.count("*").alias("n"), F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("column", "text"))), lambda x: x["text"])), 256).alias("h"))
    first = lines.where("row = 0").select(*keys, F.col("h").alias("head"))
    joined = lines.join(first, keys, "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("n").alias("columns"), (F.min("n") < F.max("n")).alias("ragged"), F.count_if((F.col("row") > 0) & (F.col("h") == F.col("head"))).alias("repeated_headers"))


def audit_workbooks(parts: DataFrame, cells: DataFrame) -> DataFrame:
    """Findings over ``office.read_parts`` and ``office.read_cells``: what a workbook's names, tables and formulas lean on.

    Sheets and names (each in its scope) that come twice without regard to case, and tables; references of names and formulas
    that are lost, lead to another workbook or to a sheet that isn't there, or show only when computed; tables whose part is
    lost, whose range is no range, or whose columns aren't the cells of its first row.
    """
    at = lambda *more: F.concat_ws("!", F.regexp_extract("path", "[^/]*$", 0), *more)
    where = lambda rows, severity, code, *more: finding(rows, "workbook", severity, code, at(*more))
    scope = F.when(F.col("kind") == "name", F.coalesce("sheet", F.lit(""))).otherwise("")
    twice = parts.where("kind <> 'lost_table'").groupBy("path", "kind", scope.alias("scope"), F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    found = [where(twice, "blocker", "repeated_name", F.col("kind"), F.col("name")), where(parts.where("kind = 'lost_table'"), "blocker", "lost_table_part", F.col("sheet"), F.col("name"))]

    names = parts.where("kind = 'name'").select("path", F.col("name").alias("place"), formula_references(F.concat(F.lit("="), "text")).alias("r"))
    formulas = cells.where("formula is not null").select("path", F.concat_ws("!", "sheet", F.concat(F.lit("R"), "row", F.lit("C"), "col")).alias("place"), formula_references(F.col("formula")).alias("r"))
    leans = names.unionByName(formulas)
    for flag, severity, code in (("broken", "blocker", "lost_reference"), ("external", "blocker", "external_reference"), ("indirect", "unverified", "computed_reference")):
        found.append(where(leans.where(f"r.{flag}"), severity, code, F.col("place")))
    known = parts.where("kind = 'sheet'").select("path", F.lower("name").alias("s"))
    led = leans.select("path", "place", F.explode("r.sheets").alias("sheet")).withColumn("s", F.lower("sheet"))
    found.append(where(led.join(known, ["path", "s"], "left_anti"), "blocker", "unknown_sheet", F.col("place"), F.col("sheet")))

    ends = F.regexp_extract_all(F.upper("text"), F.lit(r"^\$?([A-Z]{1,3})\$?([0-9]+):\$?([A-Z]{1,3})\$?([0-9]+)$"), 0)
    corner = lambda i: F.regexp_extract(F.upper("text"), r"^\$?([A-Z]{1,3})\$?([0-9]+):\$?([A-Z]{1,3})\$?([0-9]+)$", i)
    tables = parts.where("kind = 'table'").withColumn("sound", F.size(ends) == 1)
    found.append(where(tables.where("not sound"), "blocker", "table_range", F.col("name"), F.col("text")))
    heads = tables.where("sound").select("path", "sheet", "name", "columns", column_index(corner(1)).alias("left"), corner(2).cast("int").alias("row"), column_index(corner(3)).alias("right"))
    wide = heads.where(F.size("columns") != F.col("right") - F.col("left") + 1)
    found.append(where(wide, "blocker", "table_width", F.col("name")))
    want = heads.select("path", "sheet", "name", "left", "row", F.posexplode("columns").alias("k", "column")).withColumn("col", F.col("left") + F.col("k"))
    met = want.join(cells.select("path", "sheet", "row", "col", "text"), ["path", "sheet", "row", "col"], "left")
    found.append(where(met.where(folded(F.coalesce("text", F.lit(""))) != folded("column")), "blocker", "table_header", F.col("name"), F.col("column")))
    return reduce(DataFrame.unionByName, found)
