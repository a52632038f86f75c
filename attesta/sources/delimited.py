"""Delimited files with physical line numbers, strict headers, and JSON lines without silent repair."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.lines import delimited_records, numbered_lines


class SourceError(ValueError):
    """A file that can't be read as it should be."""


def format_name(path: str | Column) -> Column:
    """A column with the kind of a path by its suffix: csv, tsv, xlsx, json, sql or unsupported."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    bare = F.regexp_replace(p, r"\.gz$", "")
    return (
        F.when(bare.endswith(".csv"), "csv").when(bare.endswith(".tsv") | bare.endswith(".txt"), "tsv").when(p.endswith(".xlsx"), "xlsx")
        .when(p.endswith(".json") | p.endswith(".jsonl"), "json").when(bare.endswith(".sql"), "sql").otherwise("unsupported")
    )


def checked_header(names: list[str]) -> list[str]:
    """The header, or an error: a blank or repeated name leaves columns unnamed."""
    if not names or any(not n.strip() for n in names) or len(set(names)) < len(names):
        raise SourceError(f"header has blank or repeated names: {names}")
    return names


def read_delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, row, record`` of csv and tsv files (also gzipped), read in splits: ``row`` is the line on which a record ends.

    A byte-order mark, and blank and comment lines before the header, are skipped, as are blank lines after it; a comment line that names
    columns (``# Formula,...``) is the header. Short rows are filled with empty strings; longer ones, and headers with blank or
    repeated names, fail. Cells are never inferred. Quoted fields may hold line ends, over splits as well.
    """
    kind = format_name("f")
    delimiter = F.when(kind == "csv", ",").when(kind == "tsv", "\t").otherwise(F.raise_error(F.concat(F.col("f"), F.lit(" is no delimited file"))).cast("string"))
    records = delimited_records(spark, paths, delimiter)
    first = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    named = F.btrim(first) == "# Formula"
    heads = records.where(F.exists("cells", lambda c: F.btrim(c) != "") & (named | ~first.startswith("#"))).groupBy("path").agg(F.min(F.struct("n", "cells")).alias("head"))
    names = F.transform(F.col("head.cells"), lambda c: F.regexp_replace(F.btrim(c), "^# Formula$", "Formula"))
    wrong = F.exists(names, lambda c: c == "") | (F.size(F.array_distinct(names)) < F.size(names))
    names = F.when(wrong, F.raise_error(F.concat(F.col("path"), F.lit(": header has blank or repeated names"))).cast("array<string>")).otherwise(names)
    heads = heads.select("path", F.col("head.n").alias("first"), names.alias("names"))
    rows = records.join(heads, "path").where("n > first and size(cells) > 0")
    short = F.size("names") - F.size("cells")
    long = F.raise_error(F.concat(F.col("path"), F.lit(" line "), F.col("row"), F.lit(": "), F.size("cells"), F.lit(" cells for "), F.size("names"), F.lit(" columns"))).cast("map<string,string>")
    record = F.when(short < 0, long).otherwise(F.map_from_arrays("names", F.concat("cells", F.array_repeat(F.lit(""), F.greatest(short, F.lit(0))))))
    return rows.select("path", "row", record.alias("record"))


def strict_json(spark: SparkSession, path: str | list[str], limit: int = 16 << 20) -> DataFrame:
    """``path, row, value`` (variant) of each JSON line, read in splits; repeated keys, NaN, infinities and lines over ``limit`` bytes fail."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    long = F.when(F.octet_length("value") > limit, F.raise_error(F.lit("a line is too long")).cast("string")).otherwise(F.col("value"))
    odd = F.when(long.rlike(r'(?<!["\w])-?(NaN|Infinity)(?!["\w])'), F.raise_error(F.lit("a number is not finite")).cast("string")).otherwise(long)
    return lines.select("path", "row", F.parse_json(odd).alias("value"))


def tolerant_json(spark: SparkSession, path: str) -> DataFrame:
    """``value`` (variant, null if a line isn't valid) and ``raw``, for quarantine."""
    lines = spark.read.text(path)
    return lines.select(F.try_parse_json("value").alias("value"), F.col("value").alias("raw"))


def write_table(rows: DataFrame, path: str, first: list[str]) -> None:
    """CSV with the given columns first and the others in order of name; nested values as JSON; never over old files."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")}
    columns = [*first, *sorted(set(rows.columns) - set(first))]
    rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in columns]).write.mode("errorifexists").option("header", True).csv(path)


def strict_csv(spark: SparkSession, path: str, unique: str | None = None, skip_blank: bool = False) -> DataFrame:
    """A CSV file's columns as text, read in splits: a short or long row, a bad header or a repeated id fails.

    Fields don't reach over lines. ``skip_blank`` passes over records without any value; ``unique`` names a column whose values
    must be there and differ.
    """
    head = spark.read.text(path).first()
    if head is None:
        raise SourceError("an empty file has no header")
    names = checked_header([c.strip() for c in next(csv.reader([head["value"].lstrip("\ufeff")]))])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    if skip_blank:
        rows = rows.where(F.coalesce(*[F.when(F.trim(F.col(f"`{n}`")) != "", F.lit(True)) for n in names], F.lit(False)))
    if unique is not None:
        wrong = rows.groupBy(F.col(f"`{unique}`").alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null or trim(id) = ''").limit(5).collect()
        if wrong:
            raise SourceError(f"{unique} is missing or repeated: {[r.id for r in wrong]}")
    return rows
