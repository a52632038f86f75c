"""JSON values at any depth as rows: facts by path, and where two documents differ, all in VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.plans.staging import Staging


def _kind(v: str) -> Column:
    """object, array, number, string, boolean or null."""
    s = F.schema_of_variant(v)
    number = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(number, "number").when(s == "VOID", "null").otherwise(F.lower(s))


def _text(v: str, kind: Column) -> Column:
    """A scalar as text; numbers of one value, however written, are one text."""
    exact = F.try_variant_get(v, "$", "decimal(38,18)")
    fraction = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    real = F.try_variant_get(v, "$", "double").cast("string")
    return F.when(kind == "number", F.coalesce(F.when(exact.cast("double") == F.try_variant_get(v, "$", "double"), fraction), real)).when(kind == "null", "null").otherwise(F.try_variant_get(v, "$", "string"))


def _pointer(path: str, name: Column, place: Column) -> Column:
    return F.concat(F.col(path), F.lit("/"), F.coalesce(F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), place.cast("string")))


def _dotted(path: str, name: Column, place: Column) -> Column:
    return F.when(name.isNull(), F.concat(F.col(path), F.lit("["), place, F.lit("]"))).when(F.col(path) == "", name).otherwise(F.concat(F.col(path), F.lit("."), name))


def json_facts(rows: DataFrame, keys: list[str], column: str, skip: tuple[str, ...] = (), dotted: bool = False, raw: bool = False, strict: bool = False) -> DataFrame:
    """``keys, path, kind, value``: the scalars, and the empty objects and arrays, of a JSON column at any depth.

    Each round opens one level of all documents, so there are as many rounds as the deepest has levels. ``path`` is a JSON
    pointer, or ``dotted`` as ``a.b[0]``. Members named in ``skip`` are passed over with all they hold. A text that is no JSON
    (or has a name twice) is one fact of kind ``text``, or fails if ``strict``; a null has none. With ``raw``, numbers keep their
    spelling as VARIANT has it; without, equal numbers are equal texts.
    """
    stage, spark = Staging(rows.sparkSession, "facts"), rows.sparkSession
    parsed = rows.select(*keys, F.col(column).alias("__t"), F.lit("").alias("path"), (F.parse_json if strict else F.try_parse_json)(F.col(column)).alias("v")).where("__t is not null")
    parts = [] if strict else [parsed.where("v is null").select(*keys, "path", F.lit("text").alias("kind"), F.col("__t").alias("value"))]
    level = parsed.where("v is not null").select(*keys, "path", "v")
    named = ", ".join(f"`{k}`" for k in keys)
    for k in range(1 << 20):
        told = stage.put(level.withColumn("kind", _kind("v")), f"level{k}")
        text = F.coalesce(F.expr("cast(v as string)"), F.lit("null")) if raw else _text("v", F.col("kind"))
        empty = F.col("kind").isin("object", "array") & F.expr("to_json(v) in ('{}', '[]')")
        parts.append(told.where(~F.col("kind").isin("object", "array") | empty).select(*keys, "path", "kind", F.when(empty, F.expr("to_json(v)")).otherwise(text).alias("value")))
        nested = told.where(F.col("kind").isin("object", "array"))
        if nested.isEmpty():
            break
        opened = spark.sql(f"SELECT {named}, path, e.pos, e.key AS __name, e.value AS v FROM {{nested}}, LATERAL variant_explode(v) e", nested=nested)
        opened = opened.where(F.col("__name").isNull() | ~F.col("__name").isin(*skip)) if skip else opened
        level = opened.select(*keys, (_dotted if dotted else _pointer)("path", F.col("__name"), F.col("pos")).alias("path"), "v")
    return reduce(DataFrame.unionByName, parts)


def json_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, column, path, problem, left, right``: where cells of two tables differ, those that hold JSON by its parts.

    Order and spelling inside JSON don't matter: members are compared by name, numbers by value (1 and 1.0 are equal, 1 and "1"
    and true aren't). Other texts are compared as they are. ``problem`` is ``left_only``, ``right_only``, ``kind`` or ``value``; a
    row that one side lacks is one line with the column ``<row>``. Keys are unique on each side.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    side = lambda df: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *columns)
    a, b = side(left), side(right)
    same = reduce(lambda p, q: p & q, [a[n].eqNullSafe(b[n]) for n in names])
    lone = lambda x, y, problem: x.join(y.select(*names), same, "left_anti").select(*names, F.lit("<row>").alias("column"), F.lit("").alias("path"), F.lit(problem).alias("problem"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
    both = [x.join(y.select(*names), same, "left_semi") for x, y in ((a, b), (b, a))]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])).alias("x")
    long = [x.select(*names, cells).select(*names, "x.column", "x.cell") for x in both]
    is_json = lambda c: F.ltrim(c).startswith("{") | F.ltrim(c).startswith("[")

    def facts(df: DataFrame, name: str) -> DataFrame:
        every = [*names, "column"]
        plain = df.where(~F.coalesce(is_json(F.col("cell")), F.lit(False))).select(*every, F.lit("").alias("path"), F.when(F.col("cell").isNull(), "absent").otherwise("text").alias("kind"), F.coalesce("cell", F.lit("")).alias("value"))
        nested = json_facts(df.where(is_json(F.col("cell"))), every, "cell")
        return plain.unionByName(nested).select(*every, "path", F.struct("kind", "value").alias(name))

    p, q = facts(long[0], "__l").alias("p"), facts(long[1], "__r").alias("q")
    on = reduce(lambda x, y: x & y, [F.col(f"p.{n}").eqNullSafe(F.col(f"q.{n}")) for n in [*names, "column", "path"]])
    met = p.join(q, on, "full_outer").select(*[F.coalesce(f"p.{n}", f"q.{n}").alias(n) for n in [*names, "column", "path"]], "__l", "__r")
    problem = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").when(F.col("__l.kind") != F.col("__r.kind"), "kind").when(F.col("__l.value") != F.col("__r.value"), "value")
    found = met.select(*names, "column", "path", problem.alias("problem"), F.col("__l.value").alias("left"), F.col("__r.value").alias("right")).where("problem is not null")
    every = found.unionByName(lone(a, b, "left_only")).unionByName(lone(b, a, "right_only"))
    return every.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "column", "path", "problem", "left", "right")
