"""Queries over the given tables for adjudication, evaluation and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import adjudication, evaluate
from attesta.session import table


def span_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of their order, with a sex of their own; overlaps but for male with female."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    c = li.select(F.col("l_orderkey").alias("field_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), (F.col("p") % 50).alias("start"), (F.col("p") % 50 + 20).alias("end"), F.element_at(F.array(F.lit("Male"), F.lit("female "), F.lit("unknown")), (F.col("p") % 3 + 1).cast("int")).alias("sex"))
    return adjudication.conflicts(c).groupBy("field_id").agg(F.count("*").alias("n"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("field_id"))
    act = F.element_at(F.array(*map(F.lit, ["parser", "observations", "excluded", "guess"])), (F.col("field_id") % 4 + 1).cast("int"))
    d = c.where("field_id % 9 <> 0").select("field_id", act.alias("action"), F.when(F.col("field_id") % 3 == 0, "").otherwise("why").alias("reason"), F.when(F.col("field_id") % 8 == 1, F.array(F.lit("o"))).otherwise(F.array().cast("array<string>")).alias("observations"))
    return adjudication.decision_problems(c, d.union(d.where("field_id % 50 = 1")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("path"))
    scope = s.where("k % 10 <> 0").select("path", (F.col("k") % 4 != 0).alias("reachable"))
    done = s.where("k % 3 <> 0").select("path", (F.col("k") % 5 > 1).alias("ok"), F.when(F.col("k") % 5 == 0, "timeout").alias("failure"))
    return adjudication.review_problems(scope, done).groupBy("problem").agg(F.count("*").alias("n"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    current = n.where("n_nationkey <> 7").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    k = F.col("n_nationkey")
    r = n.select(k.alias("receipt_id"), F.col("n_name").alias("path"), F.sha2(F.when(k % 6 == 1, F.lit("old")).otherwise(F.col("n_name")), 256).alias("sha256"), F.when(k % 5 == 2, "2024-01-01T00:00:00").when(k % 5 == 3, "2999-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z").alias("reviewed_at"), F.lit("R").alias("reviewer"), F.when(k == 10, "r").otherwise("p").alias("producer"), F.when(k % 4 == 0, "FAIL").otherwise("PASS").alias("outcome"), (k % 2).alias("open_blockers"))
    return adjudication.receipt_status(r, current)


def oof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("fold"))
    p = o.where("o_orderkey % 7 <> 0").union(o.where("o_orderkey % 11 = 1")).union(o.where("o_orderkey % 13 = 0").selectExpr("-o_orderkey", "fold"))
    p = p.withColumn("prediction", F.when(F.col("o_orderkey") % 17 == 0, float("nan")).otherwise(1.0))
    return evaluate.coverage_problems(o, p, ["o_orderkey", "fold"]).select("o_orderkey", "problem")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("fold"), "value")
    p = e.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("candidate_id"), "event_id", "value").select("candidate_id", "event_id", (F.col("value") + F.when(F.col("candidate_id") == "a", 1.0).otherwise(F.col("event_id") % 5)).alias("prediction"))
    got = evaluate.evaluate(e, p, "event_id", "fold", 3, "value")
    return got.select("candidate_id", "n", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("r2", 5).alias("r2"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("fold"), "value")
    return evaluate.fold_baseline(e, "fold", 4, "value").select("fold", F.round("baseline", 6).alias("baseline"))


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"), "source")
    return evaluate.leaks(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), ["text_hash", "source"])


def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fixes = spark.createDataFrame([("o_orderstatus", "F", "final"), ("o_orderstatus", "F", "done"), ("o_orderpriority", "2-HIGH", "high"), ("o_orderpriority", "F", "never")], "field string, term string, fixed string")
    got = evaluate.fix_terms(o, "o_orderkey", ["o_orderstatus", "o_orderpriority"], fixes)
    return got.groupBy("field", "term", F.array_join("fixed", ",").alias("fixed")).agg(F.count("*").alias("n"))


def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    claimed = c.where("c_nationkey <> 3").groupBy("c_nationkey").agg((F.count("*") + F.when(F.col("c_nationkey") % 7 == 0, 1).otherwise(0)).alias("n"))
    return evaluate.accounting_problems(claimed, c, ["c_nationkey"])


def rule_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    ranges = evaluate.fit_ranges(part.where("p_partkey % 2 = 0"), ["p_size", "p_retailprice"])
    got = evaluate.contributions(part, "p_partkey", ranges, 4, {("p_size", 0): 1.5, ("p_size", 3): -2.0, ("p_retailprice", 1): 0.25}, 3.0)
    return got.groupBy("p_partkey").agg(F.round(F.sum("contribution"), 6).alias("score"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("=SUM('It''s "), "n_regionkey", F.lit("'!A1:B2)+Sheet"), F.col("n_nationkey") % 3, F.lit('!C3&"Text!A1"')).alias("f"))
    return n.select(F.explode(evaluate.sheet_references("f")).alias("sheet")).groupBy("sheet").agg(F.count("*").alias("n"))


QUERIES = {
    "q_v01_span_conflicts": span_conflicts, "q_v48_decisions": decisions, "q_v05_reviews": reviews, "q_v45_receipts": receipts, "q_j16_oof_coverage": oof_coverage, "q_d17_evaluate": evaluated,
    "q_a23_fold_baseline": baseline, "q_d17_leaks": leaked, "q_j11_fix_terms": fixed, "q_v10_accounting": accounting, "q_d18_rule_basis": rule_basis, "q_f08_sheet_references": sheets,
}

ORACLE = {
    "q_v01_span_conflicts": """WITH c AS (SELECT l_orderkey AS f, l_orderkey * 10 + l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)
      SELECT a.f AS field_id, count(*) AS n FROM c a JOIN c b ON a.f = b.f AND a.i < b.i AND abs(a.p % 50 - b.p % 50) < 20 WHERE NOT ((a.p % 3 = 0 AND b.p % 3 = 1) OR (a.p % 3 = 1 AND b.p % 3 = 0)) GROUP BY 1""",
    "q_v48_decisions": """WITH c AS (SELECT c_custkey AS k FROM customer), d AS (SELECT k FROM c WHERE k % 9 <> 0 UNION ALL SELECT k FROM c WHERE k % 9 <> 0 AND k % 50 = 1)
      SELECT * FROM (SELECT k AS field_id, 'missing' AS problem FROM c WHERE k % 9 = 0 UNION ALL SELECT k, 'repeated' FROM c WHERE k % 9 <> 0 AND k % 50 = 1
      UNION ALL SELECT k, CASE WHEN k % 4 = 3 THEN 'unknown_action' WHEN k % 4 = 1 AND k % 8 <> 1 THEN 'no_observations' WHEN k % 4 = 2 AND k % 3 = 0 THEN 'no_reason' END FROM d) WHERE problem IS NOT NULL""",
    "q_v05_reviews": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 10 <> 0 AS inn, s_suppkey % 4 <> 0 AS reach, s_suppkey % 3 <> 0 AS seen, s_suppkey % 5 > 1 AS ok, s_suppkey % 5 = 0 AS fail FROM supplier)
      SELECT problem, count(*) AS n FROM (SELECT CASE WHEN NOT inn AND seen THEN 'outside_scope' WHEN NOT inn THEN NULL WHEN seen AND ok THEN NULL WHEN seen AND fail AND NOT reach THEN NULL WHEN seen AND fail THEN 'reachable_but_failed' ELSE 'not_reviewed' END AS problem FROM s) WHERE problem IS NOT NULL GROUP BY 1""",
    "q_v45_receipts": """SELECT n_nationkey AS receipt_id, CASE WHEN n_nationkey % 5 IN (2, 3) OR n_nationkey = 10 THEN 'INVALID' WHEN n_nationkey = 7 OR n_nationkey % 6 = 1 THEN 'STALE' WHEN n_nationkey % 4 = 0 THEN 'REJECTED'
      WHEN n_nationkey % 2 > 0 THEN 'BLOCKED' ELSE 'CURRENT_APPROVED' END AS status FROM nation""",
    "q_j16_oof_coverage": """WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k FROM o WHERE k % 7 <> 0 UNION ALL SELECT k FROM o WHERE k % 11 = 1 UNION ALL SELECT -k FROM o WHERE k % 13 = 0), c AS (SELECT k, count(*) AS n FROM p GROUP BY 1)
      SELECT * FROM (SELECT k AS o_orderkey, CASE WHEN o.k IS NULL THEN 'unexpected' WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'repeated' WHEN o.k % 17 = 0 THEN 'not_finite' END AS problem FROM o FULL JOIN c USING (k)) WHERE problem IS NOT NULL""",
    "q_d17_evaluate": """WITH e AS (SELECT event_id, event_id % 3 AS f, value AS y FROM events), b AS (SELECT x.f, avg(z.y) AS m FROM (SELECT DISTINCT f FROM e) x JOIN e z ON z.f <> x.f GROUP BY 1),
      p AS (SELECT 'a' AS c, y, y + 1 AS p FROM e UNION ALL SELECT 'b', y, y + event_id % 5 FROM e UNION ALL SELECT 'baseline', y, m FROM e JOIN b USING (f)), m AS (SELECT *, avg(y) OVER () AS mu FROM p)
      SELECT c AS candidate_id, count(*) AS n, round(avg(abs(y - p)), 5) AS mae, round(sqrt(avg((y - p) ** 2)), 5) AS rmse, round(1 - sum((y - p) ** 2) / sum((y - mu) ** 2), 5) AS r2 FROM m GROUP BY 1""",
    "q_a23_fold_baseline": "WITH e AS (SELECT event_id % 4 AS f, value FROM events) SELECT x.f AS fold, round(avg(z.value), 6) AS baseline FROM (SELECT DISTINCT f FROM e) x JOIN e z ON z.f <> x.f GROUP BY 1",
    "q_d17_leaks": """WITH d AS (SELECT doc_id, 'text_hash' AS key, md5(text) AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)
      SELECT key, value FROM d GROUP BY 1, 2 HAVING bool_or(doc_id % 4 = 0) AND bool_or(doc_id % 4 <> 0)""",
    "q_j11_fix_terms": """SELECT 'o_orderstatus' AS field, 'F' AS term, 'done,final' AS fixed, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o_orderpriority', '2-HIGH', 'high', count(*) FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "q_v10_accounting": """SELECT c_nationkey, CASE WHEN c_nationkey = 3 THEN 0 ELSE count(*) + 1 END AS claimed, count(*) AS counted FROM customer WHERE c_nationkey = 3 OR c_nationkey % 7 = 0 GROUP BY 1""",
    "q_d18_rule_basis": """WITH f AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE p_partkey % 2 = 0),
      s AS (SELECT p_partkey, least(floor(least(1, greatest(0, (p_size - a) / (b - a))) * 4), 3) AS x, least(floor(least(1, greatest(0, (p_retailprice - c) / (d - c))) * 4), 3) AS y FROM part, f)
      SELECT p_partkey, round(3.0::DOUBLE + CASE x WHEN 0 THEN 1.5 WHEN 3 THEN -2.0 ELSE 0 END + CASE y WHEN 1 THEN 0.25 ELSE 0 END, 6) AS score FROM s""",
    "q_f08_sheet_references": "SELECT sheet, count(*) AS n FROM (SELECT 'It''s ' || n_regionkey AS sheet FROM nation UNION ALL SELECT 'Sheet' || (n_nationkey % 3) FROM nation) GROUP BY 1",
}
