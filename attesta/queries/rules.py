"""Queries over the given tables for counts, order, values, ledgers and files written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import values
from attesta.operators import audit, closure, curation, evaluate, learning, metrics, reconcile, release
from attesta.plans.staging import Staging
from attesta.session import table
from attesta.sources import delimited, manifest
from attesta.streaming import lifecycle


def zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("F",), ("O",), ("X",)], "o_orderstatus string")
    return metrics.counts_by(table(spark, sf_dir, "orders"), ["o_orderstatus"], expected)


def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    got = metrics.tally(o, ["o_orderpriority"], {"open": F.col("o_orderstatus") == "O", "none": F.col("o_orderstatus") == "?"}, {"customers": "o_custkey"})
    least = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
    return got.join(least, "o_orderpriority")


def canonical_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return reconcile.canonical_order(n, ["n_regionkey"], ["n_name", "n_nationkey"]).select("n_nationkey", "place")


def ignored_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return reconcile.first_of(o, ["o_custkey"], ["o_orderkey"])


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return reconcile.stacked({"supplier": s, "customer": c}).groupBy("origin", "nation").agg(F.count("*").alias("n"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return reconcile.with_match(c, o, ["c_custkey"]).groupBy("known").agg(F.count("*").alias("n"))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    body = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.col("n_name"))).when(k % 3 == 1, F.create_map(F.lit("a"), F.col("n_name"), F.lit("a_original"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("a_original"), F.lit("old"), F.lit("a"), F.col("n_name")))
    n = table(spark, sf_dir, "nation").select("n_nationkey", body.alias("m"))
    return n.select("n_nationkey", values.side_value("m", "a", True).alias("original"), values.side_value("m", "a", False).alias("current"))


def json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(values.json_like("props", "$.k", "1").alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, ["Not  Available here", "12", "N/A", "unavailable", "reported"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(t.alias("t")).select("t", values.says_unavailable("t").alias("says")).groupBy("t", "says").agg(F.count("*").alias("n"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages as fractions, and targets that are one but for rounding."""
    k = F.col("n_nationkey")
    raw = F.when(k % 4 == 0, F.concat(k * 5, F.lit(" %"))).when(k % 4 == 1, F.concat(F.lit("0."), k)).when(k % 4 == 2, "x").otherwise("7")
    near = values.same_target(k * F.lit(1.0), k * F.when(k % 2 == 0, F.lit(1 + 1e-13)).otherwise(F.lit(1 + 1e-9)))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(values.fraction(raw), 6).alias("fraction"), near.alias("same"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 11 == 0, F.array(F.lit("no"), F.lit("no"))).when(k % 13 == 0, F.array(F.lit("no"), F.lit("maybe"))).when(k % 2 == 0, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(F.lit("no"), F.lit("yes"))).alias("classes"), F.when(k % 7 == 0, F.array(F.lit(0.25), F.lit(0.5))).when(k % 17 == 0, F.array(F.lit(-0.25), F.lit(1.25))).otherwise(F.array(F.lit(0.25), F.lit(0.75))).alias("p"))
    good, bad = evaluate.probability_problems(e, "event_id", "classes", "p", "yes")
    return good.select(F.col("probability").cast("string").alias("what")).union(bad.select("problem")).groupBy("what").agg(F.count("*").alias("n"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    plan = table(spark, sf_dir, "orders").select(k.alias("trial"), (k % 3).alias("fold"), F.lit("c").alias("config"))
    made = plan.where("trial % 10 <> 1").withColumn("config", F.when(F.col("trial") % 15 == 2, "d").otherwise(F.col("config")))
    made = made.union(made.where("trial % 20 = 3")).union(made.where("trial % 30 = 4").withColumn("trial", -F.col("trial")))
    return evaluate.study_problems(plan, made, ["trial", "fold"], ["config"]).select("trial", "problem")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    parts = {"features": c.where("c_custkey % 9 <> 0"), "scores": c.union(c.where("c_custkey % 7 = 0")), "partitions": c.union(c.where("c_custkey % 11 = 0").selectExpr("-c_custkey - 1"))}
    return evaluate.axis_problems(c, parts, "c_custkey")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    e = s.where("s_suppkey % 8 <> 0").select("s_suppkey", F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 5 == 0, None).otherwise(F.col("s_nationkey")).alias("place"))
    e = e.union(e.where("s_suppkey % 9 = 1")).union(e.where("s_suppkey % 30 = 7").withColumn("s_suppkey", -F.col("s_suppkey")))
    return closure.effect_problems(s, e, ["s_suppkey"], {"label": "s_name", "place": "s_nationkey"})


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    d = rows.where("o_orderkey % 25 <> 1").select("o_orderkey", F.when(k % 3 == 0, "excluded").otherwise("retained").alias("disposition"), F.when((k % 3 == 0) & (k % 4 != 3), F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    out = rows.where("o_orderkey % 3 <> 0 and o_orderkey % 10 <> 2 or o_orderkey % 33 = 0")
    return closure.ledger_problems(rows, d, out.union(out), "o_orderkey")


def poisoned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    support = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("npid"), F.when(F.col("n_nationkey") % 6 == 1, "").otherwise("S").alias("structure"))
    _, blocked = curation.support_index(support)
    emitted = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_nationkey").cast("string").alias("npid"), (k % 25).cast("string").alias("cas"))
    return closure.emitted_from_blocked(emitted, blocked, ["npid", "cas"]).select("c_custkey", "kind", "value")


def expected_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_custkey") % 3).alias("expected"))
    return closure.output_problems(d, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of cells written from conversations: a column for each turn but some, and headers that come again."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"), F.col("turn").alias("column"))
    cells = c.where("not (row = 2 and column = 1 and conv_id % 3 = 0)").withColumn("text", F.when((F.col("row") == 3) & (F.col("conv_id") % 2 == 0), F.lit("h0")).otherwise(F.concat(F.lit("h"), "row")))
    return audit.table_shapes(cells, ["conv_id"])


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select("o_custkey", F.lower(F.substring("o_orderpriority", 3, 4)).alias("name"), "o_orderstatus")
    return release.endpoint_table(f, ["o_custkey"], "name", "o_orderstatus", ["urge", "low"])


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as CSV, nested values as JSON, and read back strictly; each name once."""
    path = f"{Staging(spark, 'csv').root}/t"
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey").alias("more"), "n_name")
    delimited.write_table(n.coalesce(1), path, ["n_name"])
    got = delimited.strict_csv(spark, path, unique="n_name", skip_blank=True)
    return got.select("n_name", F.get_json_object("more", "$.n_nationkey").cast("int").alias("n_nationkey"), F.col("n_regionkey").cast("int").alias("n_regionkey"))


def handed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders' files before and after one of them is written anew: what changed, by role."""
    stage = Staging(spark, "handoff")
    n = table(spark, sf_dir, "nation").select("n_name")
    n.coalesce(1).write.text(f"{stage.root}/in")
    n.limit(3).coalesce(1).write.text(f"{stage.root}/out")
    before = stage.put(manifest.handoff(spark, f"{stage.root}/in", f"{stage.root}/out").where("path like '%part-%'"), "before")
    n.limit(5).coalesce(1).write.mode("overwrite").text(f"{stage.root}/in")
    after = manifest.handoff(spark, f"{stage.root}/in", f"{stage.root}/out").where("path like '%part-%'")
    known = before.select("path", "role").union(after.select("path", "role")).distinct()
    return manifest.changed_since(before, after).join(known, "path").groupBy("role", "status").agg(F.count("*").alias("n"))


def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("state"))
    return lifecycle.latest(e, ["job"], ["ts", "event_id"], ["state"]).groupBy("state").agg(F.count("*").alias("n"))


def cross_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's probabilities from a map that the other folds gave."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("fold"), "value", (F.col("event_type") == "purchase").cast("double").alias("y"))
    got = learning.calibrate_across(e, 3, "fold", "sigmoid", "y", "value", "event_id")
    return got.select("event_id", "fold", F.round("probability", 4).alias("probability"))


QUERIES = {
    "q_a01_zero_filled": zero_filled, "q_a10_tallies": tallies, "q_o02_canonical_places": canonical_places, "q_u05_ignored_inserts": ignored_inserts, "q_u07_stacked": stacked, "q_p20_probes": probes, "q_p17_sides": sides, "q_p21_json_parts": json_parts,
    "q_p28_markers": markers, "q_f24_scaled": scaled, "q_v21_probabilities": probabilities, "q_v30_studies": studies, "q_v46_axes": axes, "q_v27_effects": effects, "q_d21_ledger": ledger, "q_v12_poisoned_output": poisoned_output, "q_v14_expected_outputs": expected_outputs,
    "q_a27_shapes": shapes, "q_v40_endpoints": endpoints, "q_s22_strict_csv": csv_round_trip, "q_k09_handed_over": handed_over, "q_z06_latest_jobs": latest_jobs, "q_d12_cross_calibration": cross_calibration,
}

ORACLE = {
    "q_a01_zero_filled": "SELECT s AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (SELECT DISTINCT o_orderstatus AS s FROM orders UNION SELECT unnest(['F', 'O', 'X']))",
    "q_a10_tallies": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, 0::BIGINT AS none, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1",
    "q_o02_canonical_places": """SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}')::INT AS place FROM nation""",
    "q_u05_ignored_inserts": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1",
    "q_u07_stacked": "SELECT 'supplier' AS origin, s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY 2",
    "q_p20_probes": "SELECT known, count(*) AS n FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS known FROM customer) GROUP BY 1",
    "q_p17_sides": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 2 THEN 'old' END AS original, n_name AS current FROM nation",
    "q_p21_json_parts": "SELECT coalesce(contains(json_extract_string(props, '$.k'), '1'), false) AS hit, count(*) AS n FROM events GROUP BY 1",
    "q_p28_markers": "SELECT ['Not  Available here', '12', 'N/A', 'unavailable', 'reported'][p_partkey % 5 + 1] AS t, p_partkey % 5 IN (0, 2, 3) AS says, count(*) AS n FROM part GROUP BY 1, 2",
    "q_f24_scaled": """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN CASE WHEN n_nationkey * 5 <= 100 THEN round((n_nationkey * 5 / 100)::DOUBLE, 6) END WHEN 1 THEN round(('0.' || n_nationkey)::DOUBLE, 6) END AS fraction,
      n_nationkey % 2 = 0 AS same FROM nation""",
    "q_v21_probabilities": """SELECT what, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'class_repeated' WHEN event_id % 13 = 0 THEN 'positive_class_missing' WHEN event_id % 7 = 0 THEN 'sum_is_not_one' WHEN event_id % 17 = 0 THEN 'outside_unit'
      WHEN event_id % 2 = 0 THEN '0.25' ELSE '0.75' END AS what FROM events) GROUP BY 1""",
    "q_v30_studies": """WITH p AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT k FROM p WHERE k % 10 <> 1) SELECT k AS trial, 'missing' AS problem FROM p WHERE k % 10 = 1 UNION ALL SELECT -k, 'unplanned' FROM m WHERE k % 30 = 4
      UNION ALL SELECT k, 'repeated' FROM m WHERE k % 20 = 3 UNION ALL SELECT k, 'context_differs' FROM m WHERE k % 15 = 2 AND k % 20 <> 3""",
    "q_v46_axes": """SELECT 'features' AS axis, c_custkey, 'missing' AS problem FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'scores', c_custkey, 'repeated' FROM customer WHERE c_custkey % 7 = 0
      UNION ALL SELECT 'partitions', -c_custkey - 1, 'outside' FROM customer WHERE c_custkey % 11 = 0""",
    "q_v27_effects": """WITH s AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT k FROM s WHERE k % 8 <> 0) SELECT k AS s_suppkey, 'missing' AS problem FROM s WHERE k % 8 = 0 UNION ALL SELECT k, 'repeated' FROM e WHERE k % 9 = 1
      UNION ALL SELECT -k, 'unexpected' FROM e WHERE k % 30 = 7 UNION ALL SELECT k, 'projection_differs' FROM e WHERE k % 5 = 0 AND k % 9 <> 1""",
    "q_d21_ledger": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 2 OR o_orderkey % 33 = 0 AS out FROM orders) SELECT * FROM (SELECT k AS o_orderkey, 'missing' AS problem FROM o WHERE k % 25 = 1
      UNION ALL SELECT k, CASE WHEN k % 25 = 1 THEN CASE WHEN out THEN 'output_without_disposition' END WHEN k % 3 <> 0 AND NOT out THEN 'retained_without_output' WHEN k % 3 = 0 AND out THEN 'output_of_a_row_not_retained' WHEN k % 3 = 0 AND k % 4 = 3 THEN 'no_reason' END FROM o)
      WHERE problem IS NOT NULL""",
    "q_v12_poisoned_output": "SELECT c_custkey, 'npid' AS kind, c_nationkey::VARCHAR AS value FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 6 = 1",
    "q_v14_expected_outputs": """WITH d AS (SELECT c_custkey, c_custkey % 3 AS e FROM customer WHERE c_custkey % 5 <> 0), o AS (SELECT o_custkey AS c_custkey, count(*) AS f FROM orders GROUP BY 1)
      SELECT c_custkey, coalesce(e, 0)::BIGINT AS expected, coalesce(f, 0) AS found FROM d FULL JOIN o USING (c_custkey) WHERE coalesce(e, 0) <> coalesce(f, 0)""",
    "q_a27_shapes": """WITH c AS (SELECT conv_id, r AS row, turn FROM conversations, generate_series(0, 3) g(r) WHERE NOT (r = 2 AND turn = 1 AND conv_id % 3 = 0)), l AS (SELECT conv_id, row, count(*) AS n FROM c GROUP BY 1, 2)
      SELECT conv_id, count(*) AS rows, max(n) AS columns, min(n) < max(n) AS ragged, count(*) FILTER (WHERE row = 3 AND conv_id % 2 = 0) AS repeated_headers FROM l GROUP BY 1""",
    "q_v40_endpoints": """WITH f AS (SELECT o_custkey, lower(substring(o_orderpriority, 3, 4)) AS name, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, name, CASE WHEN lo = hi THEN lo ELSE 'conflict' END AS v FROM f WHERE name IN ('urge', 'low'))
      SELECT o_custkey, max(v) FILTER (WHERE name = 'urge') AS urge, max(v) FILTER (WHERE name = 'low') AS low FROM s GROUP BY 1""",
    "q_s22_strict_csv": "SELECT n_name, n_nationkey, n_regionkey FROM nation",
    "q_k09_handed_over": "SELECT * FROM (VALUES ('input', 'extra', 1::BIGINT), ('input', 'missing', 1)) v(role, status, n)",
    "q_z06_latest_jobs": "SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY 1",
}
