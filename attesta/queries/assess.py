"""Queries over the given tables for aggregates, metrics, windows and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import audit, curation, metrics, splits
from attesta.session import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = F.floor(F.col("event_id") * 37 % 1000 / 10) / 100.0
    return e.select("event_id", "user_id", "event_type", (F.col("event_id") * 7 % 3 == 0).cast("int").alias("y"), p.alias("p"), "value", (F.col("value") * 0.9 + F.col("event_id") % 7).alias("fit"))


_SCORED = """s AS (SELECT event_id, user_id, event_type, (event_id * 7 % 3 = 0)::INT AS y, floor(event_id * 37 % 1000 / 10) / 100::DOUBLE AS p, value, value * 0.9::DOUBLE + event_id % 7 AS fit FROM events)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = [F.count_distinct("l_quantity").alias("kinds"), F.round(F.sum("l_quantity"), 2).alias("quantity")]
    return curation.replicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], measures)


def replicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return curation.replicate_flag(li, ["l_partkey"], "often", 20).groupBy("l_returnflag", "often").agg(F.count("*").alias("n"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.regression(_scored(spark, sf_dir), ["event_type"], "value", "fit")
    return got.select("event_type", "n", *[F.round(c, 5).alias(c) for c in ("mae", "rmse", "r2", "target_mean", "target_population_sd")], "r2_undefined_reason")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("y", F.when(F.col("event_type") == "view", 0).otherwise(F.col("y")))
    got = metrics.confusion(rows, ["event_type"], "y", "p", F.lit(0.5))
    return got.select("event_type", "n", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "sensitivity", "specificity", "balanced_accuracy", "mcc")], "sensitivity_undefined_reason", "mcc_undefined_reason")


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.ranking(_scored(spark, sf_dir), ["event_type"], "y", "p")
    return got.select("event_type", F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"))


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("domain", F.when(F.col("p") > 0.6, "in").when(F.col("p") > 0.2, "out").otherwise("abstain"))
    measures = [F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("fit"))), 6).alias("mae")]
    return metrics.slices(rows, [["event_type", "domain"], ["event_type"], ["domain"], []], measures)


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals over ten given resamplings of the users."""
    rows = _scored(spark, sf_dir)
    times = rows.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("rep")).withColumn("times", ((F.col("user_id") * (F.col("rep") + 1) + F.col("rep")) % 5 % 3).cast("long"))
    got = metrics.bootstrap_intervals(rows, "user_id", "value", "fit", times)
    return got.select("metric", F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"), "valid")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.threshold_sweep(_scored(spark, sf_dir), "y", "p", [k / 10 for k in range(1, 10)], "mcc", 0.2, 0.2)
    return got.select("threshold", F.round("score", 6).alias("score"), "selection_eligible", "best")


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("candidate"), F.col("o_orderkey").alias("trial"), F.round("o_totalprice", 2).alias("score"))
    return metrics.best_candidate(o, ["o_custkey"], ["score", "candidate", "trial"])


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), (F.col("n_nationkey") % 4).cast("long").alias("expected"))
    ledger = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("cell"), F.when(F.col("s_suppkey") % 3 == 0, "failed").when(F.col("s_suppkey") % 3 == 1, "complete").otherwise("running").alias("status"), (F.col("s_suppkey") % 5).alias("config"))
    return metrics.coverage(expected, ledger, ["cell"])


def lower_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.lower_quantile(_scored(spark, sf_dir), ["event_type"], "p", 0.05)


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("fold", (F.col("event_id") % 3).cast("long"))
    return metrics.pooled_scores(rows, "event_type", "fold", "value", "fit").select("event_type", "fold", F.round("score", 6).alias("score"))


def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that a conversation lacks or has twice; turns are counted from 0 there, numbers from 1."""
    c = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 5 <> 0")
    again = c.where("conv_id % 11 = 3 and turn = 1")
    got = audit.gaps_and_repeats(c.union(again).select("conv_id", (F.col("turn") + 1).alias("number")), "conv_id", "number")
    return got.select("conv_id", "problem", F.explode(F.sequence("number", "upto")).alias("number"))


def monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user whose value does not exceed that of the one before."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    return audit.not_rising(e, ["user_id"], "at", ["value"]).select("event_id", F.array_join("stalled", ",").alias("stalled"))


def tag_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ordinals(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn", "text"], "ordinal").select("conv_id", "turn", "role", "ordinal")


def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant turn the nearest user turn at most four turns back."""
    c = audit.nearest_before(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", 4, "asked")
    return c.where("role = 'assistant'").select("conv_id", "turn", "asked")


def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fold_of(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("g")), "g", 5, 92, "outer")


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("g"))
    return splits.terminal_holdout(rows, "g", 92, 0.25).groupBy("g", "partition").agg(F.count("*").alias("n"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' groups joined by nation and by segment for every tenth customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("declared"), F.when(F.col("c_custkey") % 500 == 0, F.lit("bridge")).otherwise(F.concat(F.lit("own"), (F.col("c_nationkey") % 25).cast("string"))).alias("key"))
    got = splits.connected_groups(c, "parent", "id", "declared", "key")
    return got.groupBy("effective_group_id").agg(F.count("*").alias("n"))


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.operators.reconcile import membership_problems

    o = table(spark, sf_dir, "orders").select("o_orderkey")
    parts = o.where("o_orderkey % 4 <> 0").union(o.where("o_orderkey % 10 = 1")).union(o.where("o_orderkey % 8 = 0").selectExpr("-o_orderkey"))
    return membership_problems(o, parts, "o_orderkey").groupBy("problem").agg(F.count("*").alias("n"))


QUERIES = {
    "q_a02_replicates": replicates, "q_w05_replicate_flag": replicate_flag, "q_a11_regression": regression, "q_a12_confusion": confusion, "q_a13_ranking": ranking,
    "q_a14_slices": sliced, "q_a15_bootstrap_given": bootstrap, "q_a16_pooled_scores": pooled, "q_a17_threshold_sweep": sweep, "q_a18_best_candidate": best,
    "q_a19_coverage_grid": coverage, "q_a20_lower_quantile": lower_quantile, "q_a25_contiguity": contiguity, "q_a26_monotonic": monotonic, "q_w01_tag_ordinal": tag_ordinal,
    "q_w08_look_back": look_back, "q_w06_hash_folds": hash_folds, "q_o04_terminal_holdout": holdout, "q_d03_components": components, "q_u04_partition_check": once,
}

_CONF = "count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn"
ORACLE = {
    "q_a02_replicates": "SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT l_quantity) AS kinds, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "q_w05_replicate_flag": "SELECT l_returnflag, often, count(*) AS n FROM (SELECT l_returnflag, count(*) OVER (PARTITION BY l_partkey) > 20 AS often FROM lineitem) GROUP BY 1, 2",
    "q_a11_regression": f"""WITH {_SCORED}, m AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS mu FROM s)
      SELECT event_type, count(*) AS n, round(avg(abs(value - fit)), 5) AS mae, round(sqrt(avg((value - fit) ** 2)), 5) AS rmse, round(1 - sum((value - fit) ** 2) / sum((value - mu) ** 2), 5) AS r2,
      round(avg(value), 5) AS target_mean, round(stddev_pop(value), 5) AS target_population_sd, NULL::VARCHAR AS r2_undefined_reason FROM m GROUP BY 1""",
    "q_a12_confusion": f"""WITH {_SCORED}, v AS (SELECT event_type, p, CASE WHEN event_type = 'view' THEN 0 ELSE y END AS y FROM s), c AS (SELECT event_type, count(*) AS n, {_CONF} FROM v GROUP BY 1)
      SELECT event_type, n, tp, tn, fp, fn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity,
      round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
      round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc,
      CASE WHEN tp + fn = 0 THEN 'no_positive_targets' END AS sensitivity_undefined_reason, CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 'single_class_target' WHEN tp + fp = 0 OR tn + fn = 0 THEN 'single_class_prediction' END AS mcc_undefined_reason FROM c""",
    "q_a13_ranking": f"""WITH {_SCORED}, g AS (SELECT event_type, p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM s GROUP BY 1, 2),
      w AS (SELECT *, coalesce(sum(a) OVER o, 0)::DOUBLE AS pa, coalesce(sum(b) OVER o, 0)::DOUBLE AS pb FROM g WINDOW o AS (PARTITION BY event_type ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT event_type, round(sum(b * (pa + a / 2)) / (sum(a)::DOUBLE * sum(b)), 6) AS roc_auc, round(sum(a * (pa + a) / (pa + a + pb + b)) / sum(a), 6) AS average_precision FROM w GROUP BY 1""",
    "q_a14_slices": f"""WITH {_SCORED}, d AS (SELECT *, CASE WHEN p > 0.6 THEN 'in' WHEN p > 0.2 THEN 'out' ELSE 'abstain' END AS domain FROM s)
      SELECT event_type, domain, concat_ws(',', CASE WHEN grouping(event_type) = 0 THEN 'event_type' END, CASE WHEN grouping(domain) = 0 THEN 'domain' END) AS level, count(*) AS n, round(avg(abs(value - fit)), 6) AS mae FROM d GROUP BY GROUPING SETS ((event_type, domain), (event_type), (domain), ())""",
    "q_a15_bootstrap_given": f"""WITH {_SCORED}, r AS (SELECT rep, value, fit, (user_id * (rep + 1) + rep) % 5 % 3 AS t FROM s, generate_series(0, 9) g(rep)),
      m AS (SELECT rep, sum(t * abs(value - fit)) / sum(t) AS mae, sqrt(sum(t * (value - fit) ** 2) / sum(t)) AS rmse, 1 - sum(t * (value - fit) ** 2) / (sum(t * value * value) - sum(t * value) ** 2 / sum(t)) AS r2 FROM r GROUP BY 1),
      l AS (UNPIVOT (SELECT mae, rmse, r2 FROM m) ON mae, rmse, r2 INTO NAME metric VALUE v)
      SELECT metric, round(quantile_cont(v, 0.025), 5) AS lower, round(quantile_cont(v, 0.975), 5) AS upper, count(v) AS valid FROM l GROUP BY 1""",
    "q_a16_pooled_scores": f"""WITH {_SCORED} SELECT event_type, (event_id % 3)::BIGINT AS fold, round(sqrt(avg((value - fit) ** 2)), 6) AS score FROM s GROUP BY 1, 2
      UNION ALL SELECT event_type, NULL, round(sqrt(avg((value - fit) ** 2)), 6) FROM s GROUP BY 1""",
    "q_a17_threshold_sweep": f"""WITH {_SCORED}, t AS (SELECT k / 10::DOUBLE AS threshold FROM generate_series(1, 9) g(k)),
      c AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p < threshold AND y = 0)::DOUBLE AS tn, count(*) FILTER (WHERE p >= threshold AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE p < threshold AND y = 1)::DOUBLE AS fn FROM s, t GROUP BY 1),
      m AS (SELECT threshold, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS score, tp / (tp + fn) >= 0.2 AND tn / (tn + fp) >= 0.2 AND abs(tp / (tp + fn) - tn / (tn + fp)) <= 1 AS selection_eligible FROM c)
      SELECT threshold, round(score, 6) AS score, selection_eligible, threshold = (SELECT threshold FROM m ORDER BY selection_eligible DESC, score DESC, threshold LIMIT 1) AS best FROM m""",
    "q_a18_best_candidate": """SELECT o_custkey, score, candidate, trial FROM (SELECT o_custkey, o_orderpriority AS candidate, o_orderkey AS trial, round(o_totalprice, 2) AS score,
      row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2), o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1""",
    "q_a19_coverage_grid": """WITH e AS (SELECT n_nationkey AS cell, (n_nationkey % 4)::BIGINT AS expected FROM nation),
      l AS (SELECT s_nationkey AS cell, count(*) AS attempted, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS complete, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS failed, count(DISTINCT s_suppkey % 5) AS configs FROM supplier WHERE s_nationkey < 20 GROUP BY 1)
      SELECT cell, expected, coalesce(attempted, 0) AS attempted, coalesce(complete, 0) AS complete, coalesce(failed, 0) AS failed, coalesce(configs, 0) AS configs, greatest(expected - coalesce(complete, 0) - coalesce(failed, 0), 0) AS pending FROM e LEFT JOIN l USING (cell)""",
    "q_a20_lower_quantile": f"WITH {_SCORED}, r AS (SELECT event_type, p, row_number() OVER (PARTITION BY event_type ORDER BY p) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM s) SELECT event_type, p AS quantile FROM r WHERE k = floor((n - 1) * 0.05::DOUBLE)",
    "q_a25_contiguity": """WITH c AS (SELECT conv_id, turn + 1 AS number FROM conversations WHERE (conv_id + turn) % 5 <> 0 UNION ALL SELECT conv_id, 2 FROM conversations WHERE conv_id % 11 = 3 AND turn = 1 AND (conv_id + 1) % 5 <> 0),
      m AS (SELECT conv_id, max(number) AS m FROM c GROUP BY 1)
      SELECT conv_id, 'repeated' AS problem, number::BIGINT AS number FROM c GROUP BY conv_id, number HAVING count(*) > 1
      UNION ALL SELECT conv_id, 'missing', number FROM (SELECT conv_id, unnest(generate_series(1, m)) AS number FROM m) WHERE (conv_id, number) NOT IN (SELECT conv_id, number FROM c)""",
    "q_a26_monotonic": "SELECT event_id, 'value' AS stalled FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE value <= b",
    "q_w01_tag_ordinal": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text)::INT AS ordinal FROM conversations",
    "q_w08_look_back": """SELECT conv_id, turn, asked FROM (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS asked FROM conversations) WHERE role = 'assistant'""",
    "q_w06_hash_folds": """SELECT g, ((row_number() OVER (ORDER BY sha256('[92,"outer","' || g || '"]'), g) - 1) % 5)::INT AS fold FROM (SELECT c_custkey::VARCHAR AS g FROM customer)""",
    "q_o04_terminal_holdout": """WITH g AS (SELECT o_custkey::VARCHAR AS g, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sha256('[92,"terminal","' || g || '"]'), g) AS k, count(*) OVER () AS m FROM g)
      SELECT g, CASE WHEN k <= ceil(m * 0.25::DOUBLE) THEN 'terminal' ELSE 'development' END AS partition, n FROM r""",
    "q_d03_components": """WITH c AS (SELECT 'n' || c_nationkey AS d, CASE WHEN c_custkey % 500 = 0 THEN 'bridge' ELSE 'own' || (c_nationkey % 25) END AS k FROM customer),
      b AS (SELECT DISTINCT d FROM c WHERE k = 'bridge'), x AS (SELECT CASE WHEN d IN (SELECT d FROM b) THEN 'all' ELSE d END AS comp, k FROM c)
      SELECT 'parent:' || sha256('[' || string_agg(DISTINCT '"' || k || '"', ',' ORDER BY '"' || k || '"') || ']') AS effective_group_id, count(*) AS n FROM x GROUP BY comp""",
    "q_u04_partition_check": """WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k FROM o WHERE k % 4 <> 0 UNION ALL SELECT k FROM o WHERE k % 10 = 1 UNION ALL SELECT -k FROM o WHERE k % 8 = 0),
      c AS (SELECT k, sum(u) AS u, sum(x) AS x FROM (SELECT k, 1 AS u, 0 AS x FROM o UNION ALL SELECT k, 0, 1 FROM p) GROUP BY 1)
      SELECT CASE WHEN u = 0 THEN 'outside' WHEN x = 0 THEN 'missing' ELSE 'repeated' END AS problem, count(*) AS n FROM c WHERE u = 0 OR x <> 1 GROUP BY 1""",
}
