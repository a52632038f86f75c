"""Queries without SQL counterparts: learning, sources and audits over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import audit, learning
from attesta.plans.staging import Staging
from attesta.session import table
from attesta.sources import manifest, sql_dump


def ridge_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of a part's price from its key and size."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("fold"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 1000).cast("double").alias("k"), "p_retailprice")
    make = lambda: learning.pipeline(["size", "k"], learning.estimator("ridge", alpha=0.1), "p_retailprice")
    return learning.out_of_fold(part, 3, "fold", make, "p_partkey")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a purchase after a sigmoid over the value."""
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "purchase").cast("double").alias("y"))
    got = learning.calibrate(e, "sigmoid", "y", "value").transform(e)
    return got.select("event_id", F.round(learning.score_column(got), 6).alias("probability"))


def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a dump and read back, with an ordered digest of each table."""
    path = Staging(spark, "dumpfile").root
    values = F.concat(F.lit("("), "n_nationkey", F.lit(",'"), F.regexp_replace("n_name", "'", "''"), F.lit("')"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("INSERT INTO `nation` VALUES "), values, F.lit(";")).alias("value"))
    create = spark.range(1).select(F.lit("CREATE TABLE `nation` (`n_nationkey` int, `n_name` varchar(25), PRIMARY KEY (`n_nationkey`));").alias("value"))
    create.unionByName(rows).coalesce(1).write.text(path)
    return sql_dump.read_dump(spark, path)[1].select("table_name", F.col("body")["n_nationkey"].cast("int").alias("n_nationkey"), F.col("body")["n_name"].alias("n_name"))


def dump_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a dump of several rows a statement, of which two segments are read back."""
    path = Staging(spark, "dumpfile").root
    quoted = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace("c_mktsegment", r"\\\\", r"\\\\\\\\"), "'", "''"), F.lit(";\\n'"))
    value = F.concat(F.lit("("), "c_custkey", F.lit(","), quoted, F.lit(","), F.when(F.col("c_custkey") % 9 == 0, F.lit("NULL")).otherwise(F.col("c_acctbal").cast("string")), F.lit(")"))
    rows = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 97).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(value)), ",\n").alias("v"))
    inserts = rows.select(F.concat(F.lit("INSERT INTO `c` (`k`,`seg`,`bal`) VALUES "), "v", F.lit("; /* 'done; */")).alias("value"))
    create = spark.range(1).select(F.lit("CREATE TABLE `c` (`k` int, `seg` varchar(25), `bal` decimal(12,2));").alias("value"))
    create.unionByName(inserts).coalesce(1).write.text(path)
    _, got = sql_dump.read_dump(spark, path, where={"c": ("seg", ["BUILDING;\n", "MACHINERY;\n"])})
    return got.select(F.col("body")["k"].cast("long").alias("c_custkey"), F.btrim(F.col("body")["seg"], F.lit(";\n")).alias("segment"), F.col("body")["bal"].isNull().alias("no_balance"))


def checksum_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and hashes written as a checksum list and read back."""
    path = Staging(spark, "checksums").root
    n = table(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("h"), F.concat(F.lit("dir/"), F.regexp_replace("n_name", " ", "_")).alias("p"), "n_nationkey")
    lines = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat("h", F.lit("  "), "p")).otherwise(F.concat(F.lit("SHA256 ("), "p", F.lit(") = "), F.upper("h"))).alias("value"))
    lines.coalesce(1).write.text(path)
    return manifest.checksums(spark, path + "/part-*").select("path", "sha256", "problem")


def bundle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in documents written from parts, with wrong and missing references."""
    p = table(spark, sf_dir, "part").select(F.lit("doc").alias("path"), F.col("p_partkey").cast("int").alias("block"), (F.col("p_partkey") % 9 + 1).alias("a"))
    text = F.when((F.col("block") % 10 == 0) & (F.col("block") % 70 != 0), F.concat(F.lit("Figure "), F.col("block") / 10, F.lit(". caption"))).otherwise(F.concat(F.lit("see [") , "a", F.lit("-"), F.col("a") + 1, F.lit("] and Figs. "), "a", F.lit(" to "), F.col("a") + 1))
    text = F.regexp_replace(text, r"(\d)\.0\.", "$1.")
    refs = spark.range(1, 9).select(F.col("id").alias("number"))
    return audit.audit_documents(p.select("path", "block", text.alias("text")), refs)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_name", "s_acctbal", "s_nationkey")
    claimed = s.where("s_suppkey % 20 <> 3").withColumn("s_acctbal", F.when(F.col("s_nationkey") == 4, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal") * (1 + 1e-7))).withColumn("s_name", F.upper("s_name"))
    return audit.validate_report(claimed, s, "s_name", ["s_acctbal"], ["s_nationkey"])


QUERIES = {"q_d09_ridge_oof": ridge_oof, "q_d12_calibration": calibration, "q_s12_sql_dump": dump_rows, "q_s11_dump_filter": dump_filtered, "q_s28_checksums": checksum_list, "q_d25_bundle_audit": bundle_audit, "q_d26_report_validate": report}

ORACLE = {
    "q_d25_bundle_audit": """WITH f AS (SELECT p_partkey // 10 AS n FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 70 <> 0), u AS (SELECT DISTINCT unnest([p_partkey % 9 + 1, p_partkey % 9 + 2]) AS n FROM part WHERE p_partkey % 10 <> 0 OR p_partkey % 70 = 0)
      SELECT 'bibliography' AS gate, 'blocker' AS severity, 'citation_without_entry' AS code, n::VARCHAR AS detail FROM u WHERE n > 8
      UNION ALL SELECT 'figure_table_references', 'blocker', 'figure_without_caption', n::VARCHAR FROM u WHERE n NOT IN (SELECT n FROM f)
      UNION ALL SELECT 'figure_table_references', 'blocker', 'caption_sequence', 'figure ' || n || ' missing' FROM (SELECT unnest(generate_series(1, (SELECT max(n) FROM f))) AS n) WHERE n NOT IN (SELECT n FROM f)""",
    "q_s12_sql_dump": "SELECT 'nation' AS table_name, n_nationkey, n_name FROM nation",
    "q_s11_dump_filter": "SELECT c_custkey, c_mktsegment AS segment, c_custkey % 9 = 0 AS no_balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "q_s28_checksums": "SELECT 'dir/' || replace(n_name, ' ', '_') AS path, sha256(n_name) AS sha256, NULL::VARCHAR AS problem FROM nation",
    "q_d26_report_validate": """SELECT 'report' AS gate, 'blocker' AS severity, 'value_mismatch' AS code, lower(s_name) || ':s_acctbal' AS detail FROM supplier WHERE s_suppkey % 20 <> 3 AND s_nationkey = 4
      AND abs(1) > greatest(2e-5::DOUBLE * greatest(abs(s_acctbal), abs(s_acctbal + 1)), 2e-6::DOUBLE)
      UNION ALL SELECT 'report', 'blocker', 'row_mismatch', lower(s_name) FROM supplier WHERE s_suppkey % 20 = 3""",
}
