"""Inventory of a folder of mixed files: a registry, records with lineage, and what could not be read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources import delimited, manifest, office

RECORDS = "path string, sheet string, row bigint, record map<string,string>"


@dataclass(frozen=True)
class Collected:
    """``registry``: path, bytes, sha256, format, status, rows. ``records``: path, sheet, row, record. ``gaps``: path, reason."""

    registry: DataFrame
    records: DataFrame
    gaps: DataFrame


def collect(spark: SparkSession, folder: str) -> Collected:
    """Reads every delimited file, workbook and JSON-lines file below ``folder``; the rest is listed as a gap.

    Files are hashed where they are read; each kind of file is one plan, whatever their number. SQL dumps have tables of their own: see ``sql_dump.read_dump``.
    """
    files = manifest.inventory(spark, folder)
    known = {r.path: r.format for r in files.select("path", "format").collect()}
    of = lambda *kinds: sorted(p for p, k in known.items() if k in kinds)
    parts = [spark.createDataFrame([], RECORDS)]
    if paths := of("csv", "tsv"):
        parts.append(delimited.read_delimited(spark, paths).select("path", F.lit("").alias("sheet"), "row", "record"))
    if paths := of("xlsx"):
        parts.append(office.sheet_rows(office.read_cells(spark, paths)).select("path", "sheet", F.col("row").cast("long").alias("row"), "record"))
    if paths := of("json"):
        parts.append(delimited.strict_json(spark, paths).select("path", F.lit("").alias("sheet"), "row", F.from_json(F.to_json("value"), "map<string,string>").alias("record")))
    records = reduce(DataFrame.unionByName, parts)
    counts = records.groupBy("path").agg(F.count("*").alias("rows"))
    status = F.when(F.col("format") == "unsupported", "unsupported").when(F.col("format") == "sql", "separate").otherwise("read")
    registry = files.withColumn("status", status).join(counts, "path", "left")
    gaps = registry.where("status <> 'read' or rows is null").select("path", F.when(F.col("status") == "read", "no_rows").otherwise(F.concat(F.col("status"), F.lit("_format"))).alias("reason"))
    return Collected(registry, records, gaps)


def repeated_names(files: DataFrame) -> DataFrame:
    """File names, without regard to case, that are there more than once."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("n > 1")
