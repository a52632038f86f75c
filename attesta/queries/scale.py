"""Queries over the given tables for documents compared by parts, sweeps, ledgers, stratified folds and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import archives, documents, evaluate, ledger, metrics, neighbours, splits, sweep
from attesta.session import table


def _nested(k, changed: bool):
    """A document of an order, three levels deep; in the second writing some parts are spelt or filled in another way."""
    n = F.when((k % 5 == 1) & F.lit(changed), F.concat(k.cast("string"), F.lit(".0"))).when((k % 5 == 2) & F.lit(changed), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k.cast("string"))
    tail = F.when((k % 7 == 3) & F.lit(changed), F.lit(',"more":[]')).otherwise("")
    last = F.when((k % 11 == 4) & F.lit(changed), F.lit("[1,3]")).otherwise(F.lit("[1,2,3]"))
    first = F.concat(F.lit('"a/b":{"n":'), n, F.lit(',"list":[{"x":'), last, F.lit("}]}"))
    second = F.concat(F.lit('"s":"v'), k % 3, F.lit('"'))
    return F.when(F.lit(changed), F.concat(F.lit("{ "), second, F.lit(" , "), first, tail, F.lit("}"))).otherwise(F.concat(F.lit("{"), first, F.lit(","), second, tail, F.lit("}")))


def document_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writings of the customers' documents: where they differ, by path, and rows that one of them lacks."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    side = lambda changed, lost: c.where(k % 50 != lost).select("c_custkey", _nested(k, changed).alias("doc"), F.when((k % 9 == 8) & F.lit(changed), F.lit("[C@@H]2(O)")).otherwise(F.lit("[C@@H](O)")).alias("structure"))
    return documents.json_differences(side(False, 7), side(True, 8), ["c_custkey"], ["doc", "structure"])


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalars of the suppliers' documents, by path."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _nested(F.col("s_suppkey"), False).alias("doc"))
    return documents.json_facts(s, ["s_suppkey"], "doc", skip=("s",))


def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of a length of their own: how many others of their kind overlap each."""
    e = table(spark, sf_dir, "events").select("event_type", (F.floor(F.unix_timestamp("ts") / 600)).alias("s"), (F.floor(F.unix_timestamp("ts") / 600) + F.col("event_id") % 4).alias("e"))
    return sweep.overlap_counts(e, ["event_type"], "s", "e")


def deepest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("s"), (F.unix_timestamp("ts") + 86_400 * (F.col("event_id") % 9 + 1)).alias("e"))
    return sweep.deepest(e, ["user_id"], "s", "e")


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger that was written twice in parts, with flags that came later, some of them against each other."""
    rows, flags = _ledger(spark, sf_dir)
    return ledger.laid_over(rows, flags, "o_orderkey", ["seq"], ["status", "note"])


def flag_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, flags = _ledger(spark, sf_dir)
    return ledger.ledger_problems(rows, flags, "o_orderkey", ["status", "note"])


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    k = F.col("o_orderkey")
    again = o.where(k % 10 == 0).withColumn("customer", F.when(k % 20 == 0, F.col("customer") + 1).otherwise(F.col("customer")))
    rows = o.withColumn("seq", k * 10).unionByName(again.withColumn("seq", k * 10 + 5))
    one = o.where(k % 3 == 0).select("o_orderkey", (k * 10 + 6).alias("seq"), F.lit("X").alias("status"), F.lit("first").alias("note"))
    two = o.where(k % 6 == 0).select("o_orderkey", (k * 10 + 7).alias("seq"), F.lit(None).cast("string").alias("status"), F.lit("second").alias("note"))
    three = o.where(k % 12 == 0).select("o_orderkey", (k * 10 + 8).alias("seq"), F.lit("Y").alias("status"), F.lit(None).cast("string").alias("note"))
    lone = o.where(k % 40 == 1).select((-k).alias("o_orderkey"), F.lit(1).cast("long").alias("seq"), F.lit("X").alias("status"), F.lit(None).cast("string").alias("note"))
    return rows, one.unionByName(two).unionByName(three).unionByName(lone)


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to five folds by their open and other orders: no fold has more of a class than another by more than one customer's orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "O").cast("int").alias("open"))
    f = splits.stratified_fold_of(o, "o_custkey", "open", 5, 7)
    a = f.groupBy("fold").agg(F.sum("negatives").alias("n"), F.sum("positives").alias("p"), F.count("*").alias("g"), F.max("negatives").alias("mn"), F.max("positives").alias("mp"))
    return a.agg(F.sum("n").alias("negatives"), F.sum("p").alias("positives"), F.sum("g").alias("customers"), F.count("*").alias("folds"), ((F.max("n") - F.min("n") <= F.max("mn")) & (F.max("p") - F.min("p") <= F.max("mp"))).alias("fair"))


def near_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's three nearest others by balance and nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("x"))
    got = neighbours.nearest(s, s, 3, apart=True)
    return got.select(F.col("id").alias("s_suppkey"), F.posexplode("near").alias("place", "near")).select("s_suppkey", (F.col("place") + 1).cast("long").alias("place"), F.col("near.id").alias("other"), F.round("near.distance", 4).alias("distance"))


def evened_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows for each fold's training customers, by class; how many hold something of the fold itself."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("fold"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    got = neighbours.minority_rows(c, "c_custkey", "fold", 3, "y", ["c_acctbal", "nation"], 5, 3)
    crossed = (F.col("parent") % 3 == F.col("training_of")) | (F.col("other") % 3 == F.col("training_of"))
    return got.groupBy("training_of", "y").agg(F.count("*").alias("n"), F.count_if(crossed).alias("crossed"))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bootstraps over users: draws of each, and users that can't have been drawn."""
    e = table(spark, sf_dir, "events").select("user_id")
    times = metrics.draw_multiplicities(e, "user_id", 20, 5)
    known = times.join(e.distinct().withColumn("known", F.lit(True)), "user_id", "left")
    return known.groupBy("rep").agg(F.sum("times").alias("n"), F.count_if(F.col("known").isNull()).alias("unknown"))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas written from the customers: sheets of the workbook, other workbooks, lost and indirect references."""
    k = F.col("c_custkey")
    own = F.concat(F.lit("=SUM('It''s "), k % 4, F.lit("'!A1)+S"), k % 3, F.lit('!C3&"X!A1"'))
    more = F.when(k % 5 == 1, "+[B.xlsx]Z!A1").when(k % 5 == 2, "+'[B.xlsx]Z'!A1").when(k % 5 == 3, "+#REF!A1").when(k % 5 == 4, '+INDIRECT("Z!A1")').otherwise("+A:B!C1")
    c = table(spark, sf_dir, "customer").select("c_custkey", evaluate.formula_references(F.concat(own, more)).alias("r"))
    return c.select("c_custkey", F.array_join("r.sheets", "|").alias("sheets"), "r.external", "r.broken", "r.indirect")


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents whose fields are their orders: what becomes of each field and of documents without any."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("LD50 Rat oral "), k + 1, F.lit(" mg/kg [S]"))).when(k % 4 == 1, "LD (50) unknown").when(k % 4 == 2, "no word of it")
    told = o.select(F.col("o_custkey").alias("record"), k.alias("position"), F.when(k % 3 == 0, "ntxv").otherwise("other").alias("tag"), text.alias("text"))
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    numbers = c.where(n % 5 > 0).select(n.alias("record"), (-n).alias("position"), F.lit("CASRegistryNumber").alias("tag"), F.concat(F.lit(" 64-"), n).alias("text"))
    second = c.where(n % 5 == 4).select(n.alias("record"), (-n - 10_000_000).alias("position"), F.lit("CASRegistryNumber").alias("tag"), F.lit("7-7").alias("text"))
    bare = c.select(n.alias("record"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("text"))
    got = archives.dispositions(told.unionByName(numbers).unionByName(second).unionByName(bare), ["record"])
    return got.select("record", "position", "source", "cas", "status", F.array_join("why", ",").alias("why"), "said.value")


QUERIES = {
    "q_f08_formula_references": formulas, "q_s18_archived_fields": archived,
    "q_d11_near_suppliers": near_suppliers, "q_d13_evened_out": evened_out, "q_a15_drawn": drawn,
    "q_v13_document_differences": document_differences, "q_v35_document_facts": document_facts, "q_j12_overlap_counts": overlap_counts, "q_j12_deepest": deepest_places,
    "q_k02_flagged_rows": flagged_rows, "q_k02_flag_problems": flag_problems, "q_d05_stratified_folds": stratified,
}

ORACLE = {
    "q_f08_formula_references": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'A|B|' ELSE '' END || 'It''s ' || c_custkey % 4 || '|S' || c_custkey % 3 AS sheets, c_custkey % 5 IN (1, 2) AS external, c_custkey % 5 = 3 AS broken, c_custkey % 5 = 4 AS indirect FROM customer""",
    "q_s18_archived_fields": """WITH f AS (SELECT o_custkey AS r, o_orderkey AS p, o_orderkey % 4 AS w FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 < 2),
      c AS (SELECT c_custkey AS r, CASE WHEN c_custkey % 5 IN (0, 4) THEN '' ELSE '64-' || c_custkey END AS cas, CASE c_custkey % 5 WHEN 0 THEN 'missing_native_cas' WHEN 4 THEN 'ambiguous_native_cas' END AS lacks FROM customer)
      SELECT f.r AS record, p AS "position", 'narrative_field' AS source, cas, CASE WHEN lacks IS NOT NULL THEN 'quarantined' WHEN w = 0 THEN 'candidate' WHEN w = 1 THEN 'quarantined' ELSE 'excluded' END AS status,
        concat_ws(',', CASE w WHEN 0 THEN NULL WHEN 1 THEN 'narrative_not_verified_single_rat_oral_scalar' ELSE 'no_ld50_mention' END, lacks) AS why, CASE WHEN w = 0 THEN (p + 1)::VARCHAR ELSE '' END AS value FROM f JOIN c USING (r)
      UNION ALL SELECT r, NULL, 'document_disposition', cas, 'excluded', 'no_toxicity_candidate_fields', NULL FROM c WHERE r NOT IN (SELECT r FROM f)""",
    "q_d11_near_suppliers": """SELECT s_suppkey, place, other, round(d, 4) AS distance FROM (SELECT a.s_suppkey, b.s_suppkey AS other, sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2) AS d,
      row_number() OVER (PARTITION BY a.s_suppkey ORDER BY d, b.s_suppkey) AS place FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey) WHERE place <= 3""",
    "q_d13_evened_out": """SELECT t::INT AS training_of, CASE WHEN ones < zeros THEN 1 ELSE 0 END::INT AS y, abs(ones - zeros) AS n, 0::BIGINT AS crossed FROM (SELECT t, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS ones, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS zeros
      FROM customer, generate_series(0, 2) g(t) WHERE c_custkey % 3 <> t GROUP BY t) WHERE ones <> zeros""",
    "q_a15_drawn": "SELECT rep, (SELECT count(DISTINCT user_id) FROM events) AS n, 0::BIGINT AS unknown FROM generate_series(0, 19) g(rep)",
    "q_v13_document_differences": """WITH c AS (SELECT c_custkey AS k FROM customer), m AS (SELECT k FROM c WHERE k % 50 <> 7 AND k % 50 <> 8)
      SELECT k AS c_custkey, 'doc' AS "column", '/a~1b/n' AS path, 'kind' AS problem, k::VARCHAR AS "left", k::VARCHAR AS "right" FROM m WHERE k % 5 = 2
      UNION ALL SELECT k, 'doc', '/more', 'right_only', NULL, '[]' FROM m WHERE k % 7 = 3 UNION ALL SELECT k, 'doc', '/a~1b/list/0/x/1', 'value', '2', '3' FROM m WHERE k % 11 = 4
      UNION ALL SELECT k, 'doc', '/a~1b/list/0/x/2', 'left_only', '3', NULL FROM m WHERE k % 11 = 4 UNION ALL SELECT k, 'structure', '', 'value', '[C@@H](O)', '[C@@H]2(O)' FROM m WHERE k % 9 = 8
      UNION ALL SELECT k, '<row>', '', CASE WHEN k % 50 = 8 THEN 'left_only' ELSE 'right_only' END, NULL, NULL FROM c WHERE k % 50 IN (7, 8)""",
    "q_v35_document_facts": """SELECT s_suppkey, '/a~1b/n' AS path, 'number' AS kind, s_suppkey::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, '/a~1b/list/0/x/' || (i - 1), 'number', i::VARCHAR FROM supplier, generate_series(1, 3) g(i)""",
    "q_j12_overlap_counts": """WITH e AS (SELECT event_type, floor(epoch(ts) / 600)::BIGINT AS s, (floor(epoch(ts) / 600) + event_id % 4)::BIGINT AS e FROM events), d AS (SELECT event_type, s, e, count(*) AS times FROM e WHERE s < e GROUP BY ALL)
      SELECT a.event_type, a.s, a.e, a.times, (sum(b.times) - 1)::BIGINT AS others FROM d a JOIN d b ON a.event_type = b.event_type AND a.s < b.e AND b.s < a.e GROUP BY ALL""",
    "q_j12_deepest": """WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, (floor(epoch(ts)) + 86400 * (event_id % 9 + 1))::BIGINT AS e FROM events),
      d AS (SELECT a.user_id, a.s AS "at", count(*) AS depth FROM (SELECT DISTINCT user_id, s FROM e) a JOIN e b ON a.user_id = b.user_id AND b.s <= a.s AND a.s < b.e GROUP BY 1, 2)
      SELECT user_id, depth, "at" FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY depth DESC, "at") = 1""",
    "q_k02_flagged_rows": """SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN 'Y' WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_custkey AS customer, CASE WHEN o_orderkey % 6 = 0 THEN 'second' WHEN o_orderkey % 3 = 0 THEN 'first' END AS note,
      (o_orderkey % 3 = 0)::BIGINT + (o_orderkey % 6 = 0)::BIGINT + (o_orderkey % 12 = 0)::BIGINT AS revisions FROM orders""",
    "q_k02_flag_problems": """SELECT o_orderkey, 'rewritten' AS problem FROM orders WHERE o_orderkey % 20 = 0 UNION ALL SELECT -o_orderkey, 'flag_without_row' FROM orders WHERE o_orderkey % 40 = 1
      UNION ALL SELECT o_orderkey, 'contradicted:status' FROM orders WHERE o_orderkey % 12 = 0 UNION ALL SELECT o_orderkey, 'contradicted:note' FROM orders WHERE o_orderkey % 6 = 0""",
    "q_d05_stratified_folds": "SELECT count(*) FILTER (WHERE o_orderstatus <> 'O') AS negatives, count(*) FILTER (WHERE o_orderstatus = 'O') AS positives, count(DISTINCT o_custkey) AS customers, 5::BIGINT AS folds, true AS fair FROM orders",
}
