"""Queries over the given tables for mapping, filtering, conversion and dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.values import UNITS, folded, is_close, looked_up, reasons, relation, source_text, unit_factor, unit_kind
from attesta.operators import curation
from attesta.session import table

UNIT_OF, RELATION_OF = ["mg/kg", "ug/kg", "g/kg", "mmol/kg", "mg/kg/day"], ["=", "<", "", "approx"]
_MASS = {u: f for u, (k, f) in UNITS.items() if k == "mass"}


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", pick(UNIT_OF).alias("unit"), pick(RELATION_OF).alias("rel"))


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an observation; counts and mass by disposition and reasons."""
    rows = _observations(spark, sf_dir)
    why = reasons((~F.col("event_type").isin("click", "view"), "outside_task"), (relation("rel") != "=", "nonexact"), (F.coalesce(unit_kind("unit") != "mass", F.lit(True)), "unsupported_unit"))
    rows = rows.withColumn("reasons", why).withColumn("disposition", F.when(F.size("reasons") == 0, "retained").otherwise("excluded"))
    rows = rows.withColumn("mg", F.when(F.size("reasons") == 0, F.col("value") * unit_factor("unit")))
    return rows.groupBy("disposition", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"), F.round(F.sum("mg"), 4).alias("mgkg"))


_OBS = """obs AS (SELECT event_id, user_id, event_type, value,
  list_extract(['mg/kg','ug/kg','g/kg','mmol/kg','mg/kg/day'], (event_id % 5 + 1)::INT) AS unit,
  list_extract(['=','<','','approx'], (event_id % 4 + 1)::INT) AS rel FROM events)"""


def task_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = spark.createDataFrame([("t1", "CLICK"), ("t2", "view"), ("t3", "Click")], "task_id string, event_type string")
    got = curation.explode_tasks(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), tasks, ["event_type"])
    return got.groupBy("task_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def exact_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "customer").select(looked_up("c_mktsegment", {"BUILDING": "construction", "MACHINERY": "machines"}).alias("segment"))
    return got.groupBy("segment").agg(F.count("*").alias("n"))


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).where(unit_kind("unit").isNotNull() & (F.col("value") > 0))
    mol = F.when(unit_kind("unit") == "molar", F.col("value") * unit_factor("unit")).otherwise(F.col("value") * unit_factor("unit") / (1000 * (F.col("user_id") % 50 + 100)))
    return rows.select("event_id", "unit", F.round(F.col("value") * unit_factor("unit"), 6).alias("converted"), F.round(-F.log10(mol), 6).alias("p_value"))


def reason_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    why = reasons((~F.col("event_type").isin("click", "view"), "outside_task"), (relation("rel") != "=", "nonexact"), (F.col("unit") == "mg/kg/day", "unsupported_unit"))
    sets = {"material": ["unsupported_unit"], "extraction": ["nonexact"], "scope": ["outside_task", "missing"]}
    rows = rows.select(*[F.size(F.array_intersect(why, F.array(*map(F.lit, s)))).cast("long").alias(k) for k, s in sets.items()])
    return rows.groupBy("material", "extraction", "scope").agg(F.count("*").alias("n"))


def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("effects.a.size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).alias("effects.b.size"), F.col("p_type").alias("effects.b.kind.name"), "p_name")
    return curation.effect_blocks(part, "p_partkey")


def sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, "-").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), "o_orderpriority", F.lit("\t")))
    return orders.select(source_text(raw).alias("priority")).groupBy("priority").agg(F.count("*").alias("n"))


def scope_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows named by the exact term, and rows named by any term that is mapped to it."""
    terms = spark.createDataFrame([("1-urgent",), ("2-high ",)], "term string")
    got = curation.scope_flags(table(spark, sf_dir, "orders"), "o_orderpriority", "1-urgent", terms)
    return got.groupBy("exact", "mapped").agg(F.count("*").alias("n"))


def close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_extendedprice") * (1 + (F.col("l_quantity") - 25) * 1e-6)).alias("claimed"))
    return rows.groupBy("l_returnflag").agg(F.count_if(is_close(F.col("l_extendedprice"), F.col("claimed"))).alias("close"), F.count("*").alias("n"))


def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "benchmark").select(folded("text").alias("key"))
    return docs.groupBy("key").agg(F.count("*").alias("n"))


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole curation run over customers: identity by two kinds of keys, one conflicting, one open."""
    from attesta.plans.contract import CurationContract, Task

    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("row_id"), "c_mktsegment", F.abs("c_acctbal").cast("string").alias("v"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("np"), F.when(F.col("c_custkey") % 7 == 0, F.lit("DIRECT")).otherwise("").alias("own"),
    )
    nation = table(spark, sf_dir, "nation")
    support = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("npid"), F.when(F.col("n_nationkey") % 5 == 4, "").otherwise(F.concat(F.lit("S"), F.col("n_regionkey").cast("string"))).alias("structure"), (F.lit(100.0) + F.col("n_regionkey")).alias("weight"))
    tasks = (Task("auto", "automobile", "r", "e"), Task("house", "HOUSEHOLD", "r", "e"))
    contract = CurationContract({"npid": "np", "species": "c_mktsegment", "value": "v", "smiles": "own"}, tasks, constants={"route": "r", "endpoint": "e", "unit": "mg/kg", "relation": "="})
    got = curation.curate(rows, contract, support).dispositions
    return got.groupBy("disposition", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


QUERIES = {
    "q_p12_dispositions": dispositions, "q_p06_task_explode": task_explode, "q_p03_exact_alias": exact_alias, "q_p10_unit_convert": unit_convert,
    "q_p13_reason_sets": reason_sets, "q_p14_wide_to_long": wide_to_long, "q_p16_sentinel": sentinel, "q_p22_scope_flags": scope_flags,
    "q_p26_isclose": close, "q_p27_folded_text": folded_text, "q_d02_curate": curated,
}

ORACLE = {
    "q_p12_dispositions": f"""WITH {_OBS}, r AS (SELECT *, concat_ws(',', CASE WHEN event_type NOT IN ('click','view') THEN 'outside_task' END,
      CASE WHEN rel <> '=' THEN 'nonexact' END, CASE WHEN unit NOT IN ('mg/kg','ug/kg','g/kg') THEN 'unsupported_unit' END) AS reasons FROM obs)
      SELECT CASE WHEN reasons = '' THEN 'retained' ELSE 'excluded' END AS disposition, reasons, count(*) AS n,
      round(sum(CASE WHEN reasons = '' THEN value * CASE unit WHEN 'ug/kg' THEN 0.001::DOUBLE WHEN 'g/kg' THEN 1000::DOUBLE ELSE 1::DOUBLE END END), 4) AS mgkg FROM r GROUP BY 1, 2""",
    "q_p06_task_explode": """SELECT task_id, count(*) AS n, round(sum(value), 4) AS total FROM events e
      JOIN (VALUES ('t1','CLICK'), ('t2','view'), ('t3','Click')) t(task_id, et) ON lower(e.event_type) = lower(et) GROUP BY 1""",
    "q_p03_exact_alias": "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1",
    "q_p10_unit_convert": f"""WITH {_OBS}, f AS (SELECT *, CASE unit WHEN 'mg/kg' THEN 1::DOUBLE WHEN 'ug/kg' THEN 0.001::DOUBLE WHEN 'g/kg' THEN 1000::DOUBLE ELSE 0.001::DOUBLE END AS k FROM obs WHERE unit <> 'mg/kg/day' AND value > 0)
      SELECT event_id, unit, round(value * k, 6) AS converted, round(-log10(CASE WHEN unit = 'mmol/kg' THEN value * k ELSE value * k / (1000 * (user_id % 50 + 100)) END), 6) AS p_value FROM f""",
    "q_p13_reason_sets": f"""WITH {_OBS} SELECT (unit = 'mg/kg/day')::BIGINT AS material, (rel <> '=')::BIGINT AS extraction, (event_type NOT IN ('click','view'))::BIGINT AS scope, count(*) AS n FROM obs GROUP BY 1, 2, 3""",
    "q_p14_wide_to_long": """SELECT p_partkey, 'a' AS block, 'size' AS field, p_size::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'b', 'size', (p_size + 1)::VARCHAR FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, 'b', 'kind.name', p_type FROM part""",
    "q_p16_sentinel": "SELECT CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END AS priority, count(*) AS n FROM orders GROUP BY 1",
    "q_p22_scope_flags": "SELECT lower(trim(o_orderpriority)) = '1-urgent' AS exact, lower(trim(o_orderpriority)) IN ('1-urgent','2-high') AS mapped, count(*) AS n FROM orders GROUP BY 1, 2",
    "q_p26_isclose": """SELECT l_returnflag, count(*) FILTER (WHERE abs(a - b) <= greatest(2e-5::DOUBLE * greatest(abs(a), abs(b)), 2e-6::DOUBLE)) AS close, count(*) AS n
      FROM (SELECT l_returnflag, l_extendedprice AS a, l_extendedprice * (1 + (l_quantity - 25) * 1e-6::DOUBLE) AS b FROM lineitem) GROUP BY 1""",
    "q_p27_folded_text": r"SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, count(*) AS n FROM benchmark GROUP BY 1",
    "q_d02_curate": """WITH c AS (SELECT *, c_mktsegment IN ('AUTOMOBILE','HOUSEHOLD') AS task, abs(c_acctbal) > 0 AS good, c_custkey % 7 = 0 AS own, c_nationkey % 5 = 4 AS blocked FROM customer),
      r AS (SELECT CASE WHEN blocked THEN 'unresolved_support_identity' WHEN own THEN 'identity_conflict' END AS identity, * FROM c)
      SELECT CASE WHEN identity IS NOT NULL THEN 'quarantined' WHEN task AND good THEN 'retained' ELSE 'excluded' END AS disposition,
      concat_ws(',', CASE WHEN NOT task THEN 'outside_declared_task_or_missing_stratum' END, CASE WHEN NOT good THEN 'invalid_positive_numeric_value' END, identity) AS reasons, count(*) AS n FROM r GROUP BY 1, 2""",
}
