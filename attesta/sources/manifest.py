"""File inventories and checksum lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.joins import reconcile
from attesta.sources.delimited import format_name


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes, sha256, format`` of every file below a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), format_name("path").alias("format"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``line, path, sha256, problem`` of a checksum list, in the two usual line formats or as JSON."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    lines = text.where(~F.ltrim("t").startswith("{")).select(F.posexplode(F.split("t", "\r?\n")).alias("n", "raw"))
    lines = lines.select((F.col("n") + 1).alias("line"), F.btrim("raw", F.lit(" \t\r")).alias("raw")).where("raw <> '' and not startswith(raw, '#')")
    bsd, gnu = r"^SHA256 \((.+)\) = ([0-9a-fA-F]{64})$", r"^([0-9a-fA-F]{64})\s+\*?(.+)$"
    named = lines.select(
        "line",
        F.when(F.col("raw").rlike(bsd), F.regexp_extract("raw", bsd, 1)).when(F.col("raw").rlike(gnu), F.regexp_extract("raw", gnu, 2)).alias("path"),
        F.when(F.col("raw").rlike(bsd), F.regexp_extract("raw", bsd, 2)).when(F.col("raw").rlike(gnu), F.regexp_extract("raw", gnu, 1)).alias("sha256"),
    )
    as_json = text.where(F.ltrim("t").startswith("{")).select(F.posexplode(F.from_json("t", "struct<files:array<struct<path:string,sha256:string>>>")["files"]).alias("n", "f"))
    named = named.unionByName(as_json.select((F.col("n") + 1).alias("line"), "f.path", "f.sha256"))
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+", "")
    unsafe = clean.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    problem = F.when(F.col("path").isNull(), "malformed_line").when(unsafe, "unsafe_path").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "invalid_checksum")
    got = named.select("line", clean.alias("path"), F.lower("sha256").alias("sha256"), problem.alias("problem"))
    twice = got.where("problem is null").groupBy("path").agg(F.min("line").alias("first"), F.count("*").alias("c")).where("c > 1")
    got = got.join(twice, "path", "left")
    return got.select("line", "path", "sha256", F.when((F.col("c") > 1) & (F.col("line") > F.col("first")), "duplicate_path").otherwise(F.col("problem")).alias("problem"))


def handoff(spark: SparkSession, inputs: str, outputs: str) -> DataFrame:
    """``role, path, bytes, sha256`` of all files of a stage's inputs and outputs: what the next stage is handed."""
    side = lambda folder, role: inventory(spark, folder).select(F.lit(role).alias("role"), "path", "bytes", "sha256")
    return side(inputs, "input").unionByName(side(outputs, "output"))


def changed_since(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, status`` of files that are not what they were: a check of inputs after the work that read them."""
    return reconcile(before, after, "path", "sha256").where("status <> 'current'")
