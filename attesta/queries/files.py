"""Queries over files that are written from the given tables and read back in splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.plans.staging import Staging
from attesta.session import table
from attesta.sources import ddl, delimited, dump_table, sql_dump

#: Keys that a statement of the broken dump may have.
STATEMENT_KEYS = 2000


def _written(rows: DataFrame, file: Column, order: Column, value: Column, job: str) -> str:
    """Text files, one for each ``file``, of the values in order."""
    path = Staging(rows.sparkSession, job).root
    lines = rows.select(file.alias("file"), order.alias("order"), value.alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "order").select("file", "value").write.partitionBy("file").text(path)
    return f"{path}/file=*/*"


def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as delimited files, one a nation, whose comments hold line ends, quotes and tabs; with each record's line."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat("c_name", F.repeat(F.lit("\n"), (F.col("c_custkey") % 4).cast("int")), F.lit('\t"'), "c_mktsegment", F.lit('"')).alias("note"))
    quoted = F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))
    body = c.select("c_nationkey", "c_custkey", F.concat_ws("\t", "c_custkey", quoted, F.when(F.col("c_custkey") % 5 > 0, F.lit('a 5" pipe'))).alias("v"))
    head = c.select("c_nationkey", F.lit(-1).cast("long").alias("c_custkey"), F.lit("# by nation\n\nid\tnote\tmore").alias("v")).distinct()
    path = _written(body.unionByName(head), F.col("c_nationkey"), F.col("c_custkey"), F.col("v"), "delimitedfile")
    got = delimited.read_delimited(spark, path)
    return got.select(F.col("record")["id"].cast("long").alias("c_custkey"), "row", F.col("record")["note"].alias("note"), F.col("record")["more"].alias("more"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files of JSON lines, one a nation, with blank lines between; with each record's line."""
    s = table(spark, sf_dir, "supplier")
    value = F.concat(F.repeat(F.lit("\n"), (F.col("s_suppkey") % 3).cast("int")), F.to_json(F.struct("s_suppkey", "s_name")))
    got = delimited.strict_json(spark, _written(s, F.col("s_nationkey"), F.col("s_suppkey"), value, "jsonfile"))
    return got.select(F.variant_get("value", "$.s_suppkey", "long").alias("s_suppkey"), F.variant_get("value", "$.s_name", "string").alias("s_name"), "row")


def _dump(spark: SparkSession, sf_dir: str) -> str:
    """Customers and orders as a dump of many files, where some values, keys and references are broken.

    Statements have rows of at most ``STATEMENT_KEYS`` keys, so they grow in number and not in length.
    """
    path = Staging(spark, "brokendump").root
    create = [
        "CREATE TABLE `c` (`id` int(11) NOT NULL AUTO_INCREMENT, `name` varchar(18) COLLATE utf8_bin DEFAULT NULL, `segment` varchar(10) NOT NULL DEFAULT 'x', PRIMARY KEY (`id`), UNIQUE KEY `by_name` (`name`(9)) USING BTREE) ENGINE=InnoDB DEFAULT CHARSET=utf8;",
        "CREATE TABLE `o` (`id` bigint unsigned NOT NULL, `customer` mediumint, `price` decimal(12,2) NOT NULL, `day` date, `late` tinyint(1), PRIMARY KEY (`id`), KEY `k` (`customer`), CONSTRAINT `who` FOREIGN KEY (`customer`) REFERENCES `C` (`ID`) ON DELETE SET NULL);",
    ]
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    text = lambda c: F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    name = F.concat(F.lit("Customer#"), F.when(k % 40 == 3, F.lpad((k - 1).cast("string"), 9, "0")).when(k % 40 == 7, F.lpad(k.cast("string"), 12, "0")).otherwise(F.lpad(k.cast("string"), 9, "0")))
    c = table(spark, sf_dir, "customer").select((F.floor(k / 40) % 31).alias("g"), F.floor(k / (31 * STATEMENT_KEYS)).alias("block"), k.alias("at"), F.concat_ws(",", k, text(name), F.when(k % 50 == 5, F.lit("NULL")).otherwise(text(F.col("c_mktsegment")))).alias("v"))
    who = F.when(o % 60 == 1, F.col("o_custkey") + 8_000_000).otherwise(F.col("o_custkey"))
    day = F.when(o % 70 == 2, F.lit("'2024-02-30'")).otherwise(text(F.col("o_orderdate").cast("date")))
    price = F.when(o % 80 == 3, F.lit("'ten'")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    orders = table(spark, sf_dir, "orders")
    rows = F.concat_ws(",", F.when(o % 90 == 4, o - 1).otherwise(o), F.when(o % 7 == 0, F.lit("NULL")).otherwise(who.cast("string")), price, day, F.lit("NULL"))

    def lines(rows: DataFrame, into: str) -> DataFrame:
        """A line for each statement, made of its rows alone."""
        return rows.groupBy("g", "block").applyInPandas(lambda own: pd.DataFrame({"value": [f"INSERT INTO `{into}` VALUES ({'),('.join(own.sort_values(['at', 'v'])['v'])});"]}), "value string")

    made = spark.createDataFrame([(s,) for s in create], "value string")
    made.unionByName(lines(c, "c")).unionByName(lines(orders.select((o % 199).alias("g"), F.floor(o / (199 * STATEMENT_KEYS)).alias("block"), o.alias("at"), rows.alias("v")), "o")).write.text(path)
    return path


def broken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dump's rows break of its definitions: types, lengths, keys and references, by key."""
    tables, rows = sql_dump.read_dump(spark, _dump(spark, sf_dir))
    rows = Staging(spark, "dumprows").put(rows, "rows")
    return ddl.dump_problems(rows, tables).select("table_name", "key", "name", "problem")


def typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump's orders by their defined types, prices added up by customer."""
    tables, rows = sql_dump.read_dump(spark, _dump(spark, sf_dir), only=["o"])
    return ddl.typed_rows(rows, tables["o"]).groupBy("customer").agg(F.count("*").alias("n"), F.sum("price").cast("decimal(18,2)").alias("price"), F.max("day").alias("day"))


def pushed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump's orders of some customers, chosen in the plan and found by the reader."""
    o = dump_table.dump_table(spark, _dump(spark, sf_dir), "o")
    some = [r.c for r in table(spark, sf_dir, "customer").where("c_nationkey = 3").orderBy("c_custkey").limit(40).select(F.col("c_custkey").cast("string").alias("c")).collect()]
    return o.where(F.col("customer").isin(some) & F.col("day").isNotNull()).where(F.col("price").try_cast("decimal(12,2)") > 1000).select(F.col("id").cast("long").alias("id"), F.col("customer").cast("long").alias("customer"))


QUERIES = {"q_s03_delimited_lines": delimited_lines, "q_s05_json_lines": json_lines, "q_s14_broken_rows": broken_rows, "q_s14_typed_rows": typed_orders, "q_s11_pushed_filter": pushed_orders}

ORACLE = {
    "q_s03_delimited_lines": """SELECT c_custkey, (3 + sum(1 + c_custkey % 4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::BIGINT AS "row", c_name || repeat(chr(10), (c_custkey % 4)::INT) || chr(9) || '"' || c_mktsegment || '"' AS note,
      CASE WHEN c_custkey % 5 > 0 THEN 'a 5" pipe' ELSE '' END AS more FROM customer""",
    "q_s05_json_lines": "SELECT s_suppkey, s_name, sum(1 + s_suppkey % 3) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::BIGINT AS \"row\" FROM supplier",
    "q_s14_broken_rows": """WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 90 = 4 THEN o_orderkey - 1 ELSE o_orderkey END AS id FROM orders)
      SELECT 'c' AS table_name, k::VARCHAR AS key, 'name' AS name, 'too_long' AS problem FROM c WHERE k % 40 = 7
      UNION ALL SELECT 'c', k::VARCHAR, 'segment', 'too_long' FROM customer JOIN c ON k = c_custkey WHERE length(c_mktsegment) > 10 AND k % 50 <> 5
      UNION ALL SELECT 'c', k::VARCHAR, 'by_name', 'repeated_key' FROM c WHERE k % 40 = 3
      UNION ALL SELECT 'o', id::VARCHAR, 'price', 'not_of_type' FROM o WHERE k % 80 = 3 UNION ALL SELECT 'o', id::VARCHAR, 'day', 'not_of_type' FROM o WHERE k % 70 = 2
      UNION ALL SELECT 'o', id::VARCHAR, 'who', 'broken_reference' FROM o WHERE k % 60 = 1 AND k % 7 <> 0
      UNION ALL SELECT 'o', id::VARCHAR, 'PRIMARY', 'repeated_key' FROM (SELECT id, count(*) AS n FROM o GROUP BY id) WHERE n > 1""",
    "q_s14_typed_rows": """SELECT customer, count(*) AS n, sum(price)::DECIMAL(18,2) AS price, max(day) AS day FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 60 = 1 THEN o_custkey + 8000000 ELSE o_custkey END::INT AS customer,
      CASE WHEN o_orderkey % 80 <> 3 THEN o_totalprice::DECIMAL(12,2) END AS price, CASE WHEN o_orderkey % 70 <> 2 THEN o_orderdate::DATE END AS day FROM orders) GROUP BY 1""",
    "q_s11_pushed_filter": """WITH s AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY 1 LIMIT 40) SELECT CASE WHEN o_orderkey % 90 = 4 THEN o_orderkey - 1 ELSE o_orderkey END AS id, o_custkey AS customer FROM orders
      WHERE o_orderkey % 7 <> 0 AND o_orderkey % 60 <> 1 AND o_custkey IN (SELECT c_custkey FROM s) AND o_totalprice::DECIMAL(12,2) > 1000 AND o_orderkey % 80 <> 3""",
}
