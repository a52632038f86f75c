"""Queries over the given tables for closure checks, materials, narratives and the smaller rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import canon, narrative, text, values
from attesta.operators import adjudication, audit, closure, evaluate, learning, material, metrics, reconcile, release
from attesta.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as native rows: their place, their digest and a few texts."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return li.select("l_orderkey", "l_linenumber", "p", F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "p")).alias("d"))


_LINES = "n AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, md5(l_orderkey || '|' || l_linenumber || '|' || min(l_partkey)) AS d FROM lineitem GROUP BY 1, 2)"


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _lines(spark, sf_dir)
    claimed = n.where("p % 5 <> 0").select("l_orderkey", F.when(F.col("p") % 11 == 1, F.col("l_linenumber") + 100).otherwise(F.col("l_linenumber")).alias("l_linenumber"), F.when(F.col("p") % 7 == 2, F.lit("x")).otherwise(F.col("d")).alias("d"))
    got = closure.locator_problems(claimed.union(claimed.where("l_orderkey % 9 = 0")), n, ["l_orderkey", "l_linenumber"], "d")
    return got.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "problem")


def ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 13).alias("statement"), (F.col("o_orderkey") % 4).alias("tuple"))
    return closure.not_ascending(rows, ["o_custkey"], "position", ["statement", "tuple"]).select("position")


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("original"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lower("o_orderpriority")).alias("current"))
    fixes = spark.createDataFrame([(" 2-high", "1-urgent "), (" 3-medium", "other"), (None, "1-URGENT")], "term_original string, term_final string")
    return closure.native_scope(rows, fixes, "original", "current", "1-URGENT")


_SCOPED = """s AS (SELECT o_orderkey, lower(o_orderpriority) AS o, o_orderkey % 3 = 0 AND o_orderpriority = '1-URGENT' AS exact, lower(o_orderpriority) IN ('1-urgent', '2-high') AS relevant FROM orders)"""


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).groupBy("exact", "relevant").agg(F.count("*").alias("n"))


def scope_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claimed scope that leaves rows out, has others twice and has one flag wrong, against the rebuilt one."""
    rebuilt = _scoped(spark, sf_dir).select("o_orderkey", "exact", "relevant")
    claimed = rebuilt.where("o_orderkey % 10 <> 3").withColumn("exact", F.when(F.col("o_orderkey") % 14 == 5, ~F.col("exact")).otherwise(F.col("exact")))
    claimed = claimed.union(claimed.where("o_orderkey % 22 = 1")).union(claimed.where("o_orderkey % 25 = 2").withColumn("o_orderkey", -F.col("o_orderkey")))
    return closure.flag_problems(claimed, rebuilt, ["o_orderkey"], ["exact", "relevant"])


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = closure.scope_counters(_scoped(spark, sf_dir), {"primary": F.lit(True), "exact": F.col("exact"), "union": F.col("relevant"), "none": F.lit(False)}, F.col("o_orderkey").cast("string"), ["o_orderkey"])
    return got.select("role", "n", F.col("digest").isNotNull().alias("has_digest"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scoped(spark, sf_dir)
    k = F.col("o_orderkey")
    s = rows.select("o_orderkey", "exact", "relevant", F.when(k % 4 == 0, "12").when(k % 4 == 1, "-").alias("number"))
    entries = rows.where("relevant and o_orderkey % 17 <> 1").select("o_orderkey", F.when(k % 5 == 1, "reviewed").alias("review"), F.when(k % 5 == 2, "t").alias("terminal"))
    candidates = rows.where(k % 5 >= 3).select("o_orderkey", k.alias("candidate_id")).union(rows.where(k % 30 == 1).select("o_orderkey", k))
    return closure.bridge_problems(s, entries, candidates, "o_orderkey", ["number"])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("candidate_id"), F.col("p_size").cast("string").alias("numeric_original"), F.lit("mg").alias("units_original"), F.when(k % 6 == 0, ">").otherwise("=").alias("qualifier_original"))
    return p.select("*", (F.col("numeric_original").cast("int") + 100).cast("string").alias("numeric"), F.lit("g").alias("units"), F.lit("=").alias("qualifier"))


def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = _candidates(spark, sf_dir), F.col("candidate_id")
    took = k % 2 == 0
    d = c.where("candidate_id % 19 <> 0").select(
        "candidate_id", F.when(k % 10 == 0, "excluded").when(k % 10 == 1, "later").otherwise("preserve").alias("disposition"), F.when(k % 10 == 0, F.when(k % 20 == 0, "v4_range").otherwise("v4_else")).alias("clause"),
        F.when(k % 7 == 3, F.lit("1e9")).when(took, F.col("numeric_original")).otherwise(F.col("numeric")).alias("numeric"), F.when(took | (k % 5 == 2), F.col("units_original")).otherwise(F.col("units")).alias("units"),
        F.when(k % 12 == 6, F.col("qualifier")).otherwise(F.col("qualifier_original")).alias("qualifier"),
    )
    clauses = spark.createDataFrame([("v4_range", "excluded"), ("v4_else", "scientific_quarantine")], "clause string, disposition string")
    return closure.candidate_decision_problems(c, d, clauses)


def native_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("segment_original"), F.col("c_nationkey").cast("string").alias("nation_original"))
    fixes = spark.createDataFrame([("segment", "BUILDING", 1), ("segment", "BUILDING", 2), ("nation", "4", 3), ("nation", "BUILDING", 4)], "field string, term_original string, fix_id int")
    d = c.select("candidate_id", F.when(F.col("candidate_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("candidate_id") % 3 == 1, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")).alias("fix_ids"))
    return closure.fix_problems(c, d, fixes, ["segment", "nation"])


def consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("candidate_id")
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("candidate_id"), F.md5("s_name").alias("decision_id"), F.when(F.col("s_suppkey") % 3 == 0, "excluded").otherwise("preserve").alias("disposition"))
    used = d.where("candidate_id % 8 <> 1").select("candidate_id", F.when(k % 5 == 0, "other").otherwise(F.col("decision_id")).alias("decision_id"), F.when(k % 3 == 0, "excluded").otherwise("preserved").alias("action"), F.when((k % 3 == 0) & (k % 4 != 2) | (k % 7 == 1), F.array().cast("array<bigint>")).otherwise(F.array(F.floor(k / 2))).alias("outputs"))
    return closure.consumption_problems(d, used)


def replayed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 5).alias("k"))
    saved = rows.where("k <> 2").union(rows.where("k = 3"))
    return closure.replay_difference(saved, rows, ["o_orderstatus", "o_orderpriority", "k"])


def gap_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey")
    gaps = n.groupBy(F.col("n_regionkey").cast("string").alias("source_id")).agg(F.collect_list("n_name").alias("unparsed_tables"))
    owed = closure.obligations(gaps.union(gaps))
    met = owed.join(n.where("n_nationkey % 3 = 0 or n_regionkey = 1").select(F.col("n_name").alias("table_name")), "table_name").select("obligation_id")
    return closure.gap_status(owed, met.union(met))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"), (k % 2 == 0).alias("required"), (k % 5).alias("retained"), (k % 3).alias("gaps"), (k % 7 == 0).alias("missing"))
    return closure.contract_status(s)


def unit_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    files = n.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    r = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("path"), F.sha2(F.when(k % 4 == 1, "old").otherwise(F.col("n_name")), 256).alias("sha256"), F.lit("mg/kg").alias("unit"))
    return closure.inferred_units(files, r.union(r.where("path like 'I%'")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    current = n.where("n_nationkey % 6 <> 1").select(F.col("n_name").alias("stage"), F.sha2("n_name", 256).alias("sha256"))
    accepted = n.where("n_nationkey % 5 <> 2").select(F.col("n_name").alias("stage"), F.sha2(F.when(k % 4 == 3, "old").otherwise(F.col("n_name")), 256).alias("sha256"))
    return closure.token_problems(accepted, current)


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("props is not null").select("event_id", F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").alias("ref"), F.lit("x").alias("free")).alias("used"), F.array(F.col("event_type")).alias("kinds"))).alias("doc"))
    facts = release.scalar_facts(e, "event_id", "doc")
    banned = spark.createDataFrame([("purchase",), ("3",)], "value string")
    return closure.protected_references(facts, banned).groupBy("path", "value").agg(F.count("*").alias("n"))


def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    own = r.withColumn("digest", reconcile.row_digest(["r_regionkey", "r_name"]))
    own = own.withColumn("digest", F.when(F.col("r_regionkey") == 1, None).when(F.col("r_regionkey") == 2, "zz").when(F.col("r_regionkey") == 3, F.sha2("r_name", 256)).otherwise(F.col("digest")))
    return material.digest_problems(own, "r_regionkey", ["r_regionkey", "r_name"], "digest")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return material.slot_problems(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority")


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("observation_id"), F.col("c_nationkey").cast("string").alias("cas"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("npid"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).cast("string").alias("structure"), F.col("s_nationkey").cast("string").alias("cas"), F.when(F.col("s_suppkey") % 4 == 0, "BUILDING").alias("npid"))
    got = material.support_matches(c, s, {"cas": "cas", "npid": "npid"})
    return got.select("observation_id", F.array_join("structures", ",").alias("structures"), "n_support")


def _material(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("observation_id"), F.col("o_custkey").alias("material_id"), F.when(F.col("o_orderkey") % 6 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    k = F.col("material_id")
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("material_id"))
    r = r.select("material_id", F.when(k % 5 == 0, "different").when(k % 5 == 1, "unresolved").when(k % 11 == 7, "maybe").otherwise("match").alias("outcome"), F.when(k % 7 == 3, "Ann").otherwise("Bo").alias("reviewer"), F.lit("ann").alias("producer"), F.when(k % 9 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence"), F.when(k % 8 == 2, " ").otherwise("why").alias("rationale"))
    return o, r.union(r.where("material_id % 27720 = 12").withColumn("outcome", F.lit("different")))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return material.resolution_problems(_material(spark, sf_dir)[1])


def material_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, r = _material(spark, sf_dir)
    return material.routed(o, material.material_status(o, r)).groupBy("disposition", "reason").agg(F.count("*").alias("n"))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, r = _material(spark, sf_dir)
    routes = material.routed(o, material.material_status(o, r)).where("observation_id % 13 <> 0")
    _, problems = material.finish(o, routes.union(routes.where("observation_id % 16 = 1")))
    return problems.groupBy("problem").agg(F.count("*").alias("n"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    p = table(spark, sf_dir, "nation").select((k % 3).alias("packet"), (k % 4).alias("alias"), F.concat(F.lit("f"), k % 6).alias("path"), F.md5(F.concat(F.lit("h"), F.when(k == 13, 99).otherwise(k % 6))).alias("sha256"))
    return material.packet_conflicts(p)


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("field_id"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select((F.col("o_custkey") * F.when(F.col("o_orderkey") % 50 == 0, -1).otherwise(1)).alias("field_id"), F.lit("p").alias("packet"), F.col("o_orderkey").alias("metadata"))
    out, problems = material.attach_metadata(fields, o, "field_id")
    return out.where("metadata is not null").select("field_id", F.lit("attached").alias("problem")).union(problems).groupBy("problem").agg(F.count("*").alias("n"))


def _narrated() -> Column:
    """A statement written from ``k``, whole or broken in one of its places."""
    k = F.col("k")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    return F.concat(
        F.when(k % 13 == 0, "").otherwise("LD50 "), F.when(k % 2 == 0, "Rat").otherwise("rats"), F.lit(" "), pick(["oral", "GAVAGE", "po", "skin"], k),
        pick(["", " (male)", " (gavage)", " (old)"], F.floor(k / 4)), pick([" ", " >= ", " <", " = "], F.floor(k / 3)),
        F.when(k % 5 == 0, "1,234").when(k % 5 == 1, "12,34").otherwise(F.concat(k, F.lit(".5"))), F.lit(" mg/kg"), F.when(k % 3 == 0, " bw.").otherwise(""),
        F.when(k % 7 == 0, " [Smith, 3 mg/kg]").otherwise(" [Smith]"), F.when(k % 6 == 0, " **PEER REVIEWED**").otherwise(""),
    )


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", narrative.narrative(_narrated()).alias("n")).select("k", "n.species", "n.route", "n.note", "n.relation", "n.value", "n.unit", "n.status", "n.why")


_POINTS = ["12.5", "a 12.5 b", "-12.5", "3-12.5", "12.5-20", "12.5 x 10^3", "x12.5", "12.57", "1,12.5", "12.5e3", "=12.5 mg", "2 – 12.5"]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, _POINTS)), (F.col("n_nationkey") % len(_POINTS) + 1).cast("int"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", t.alias("t")).withColumn("s", F.instr("t", "12.5") - 1)
    return n.select("n_nationkey", narrative.point_problem("t", "s", F.col("s") + 4).alias("problem"))


def brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(*map(F.lit, ["[a]", "[a][b]", "[a[b]c]", "a]", "[a", "[]", "[[a]"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ["", " **QC REVIEWED** ", " more"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    head = F.when(F.col("p_partkey") % 5 == 0, "x [y] ").otherwise("x ")
    p = table(spark, sf_dir, "part").select(q.alias("q"), tail.alias("tail"), head.alias("head"))
    got = narrative.terminal_reference(F.concat("head", "q", "tail"), F.length("head"), F.length("head") + F.length("q"))
    return p.select("q", narrative.whole_bracket("q").alias("whole"), got.alias("terminal")).groupBy("q", "whole", "terminal").agg(F.count("*").alias("n"))


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(narrative.contains_span((k % 7, k % 7 + 10), (k % 11, k % 11 + k % 4)).alias("held")).groupBy("held").agg(F.count("*").alias("n"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel letters, identifiers of sheets and tables, and two validators."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    caption = F.concat(F.lit("Figure 1. (A) one (B) two"), F.when(k % 3 == 0, " (C)").when(k % 3 == 1, " (D)").otherwise(""))
    name = F.concat(F.when(k % 2 == 0, "Supplementary Table S").otherwise("FIG. "), k)
    key = F.concat(F.repeat(F.lit("A"), F.lit(14)), F.lit("-"), F.repeat(F.lit("B"), (k % 2 + 9).cast("int")), F.lit("-N"))
    return n.select("n_nationkey", narrative.panel_letters(caption).alias("panels"), narrative.identifier(name, "table").alias("as_table"), narrative.identifier(name, "figure").alias("as_figure"), narrative.is_inchikey(key).alias("key"), narrative.is_sha256(F.when(k % 2 == 0, F.sha2("n_name", 256)).otherwise(F.md5("n_name"))).alias("digest"))


def registry_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as registry numbers, of which a third has its own check digit."""
    body = F.lpad(F.col("p_partkey").cast("string"), 5, "1")
    digit = values.mod10(F.concat(body, F.lit("0")))
    given = F.when(F.col("p_partkey") % 3 == 0, F.pmod(F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(0), lambda s, i: s + i * F.substring(body, 6 - i, F.lit(1)).cast("int")), F.lit(10))).otherwise(digit)
    number = F.concat(F.substring(body, 1, 3), F.lit("-"), F.substring(body, 4, 2), F.lit("-"), given.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", values.valid_cas(number).alias("valid"))


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", adjudication.anchored_id("n_name", "n_regionkey").alias("id"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("field_id"), F.col("n_name").alias("text"))
    k = F.col("field_id")
    e = fields.select((k * F.when(k % 7 == 3, 100).otherwise(1)).alias("field_id"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.when(k % 4 == 1, F.lower(F.substring("text", 1, 3))).otherwise(F.substring("text", 1, 3)).alias("quote"))
    return adjudication.evidence_problems(e, fields).select("field_id", "problem")


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(k.alias("candidate_id"), F.element_at(F.array(*map(F.lit, ["a", "b", "zzz"])), (k % 3 + 1).cast("int")).alias("clause"), F.when(k % 2 == 0, "excluded").otherwise("quarantined").alias("disposition"), F.when(k % 5 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("alternatives"))
    clauses = spark.createDataFrame([("a", "excluded"), ("b", "quarantined")], "clause string, disposition string")
    return adjudication.terminal_problems(t, clauses).groupBy("problem").agg(F.count("*").alias("n"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    asked = n.select(k.alias("notice_id"), F.array(F.lit("a"), F.lit("b"), F.col("n_name")).alias("members"))
    answers = n.select(k.alias("notice_id"), F.when(k % 2 == 0, "a").otherwise(F.col("n_name")).alias("member"))
    return adjudication.unaddressed(asked, answers)


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 9 == 0, 2).otherwise((k % 2).cast("int")).alias("y"), F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("prediction"), F.when(k % 5 == 0, None).otherwise(0.5).alias("threshold"))
    return evaluate.label_problems(e, "event_id").groupBy("problem").agg(F.count("*").alias("n"))


def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("d"))
    return evaluate.lineage_problems([c, c.withColumn("d", F.when(F.col("c_custkey") % 6 == 0, "x").otherwise(F.col("d"))), c.where("c_custkey % 4 = 0")], "c_custkey", "d")


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("prediction"))
    again = e.where("event_id % 5 <> 0").withColumn("prediction", F.when(F.col("event_id") % 3 == 0, F.col("prediction") + 0.001).otherwise(F.col("prediction") * (1 + 1e-9)))
    return evaluate.replay_problems(e, again, "event_id").select("event_id")


def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    listed = n.where("n_nationkey % 5 <> 0").select(k.alias("line"), F.col("n_name").alias("path"), F.sha2(F.when(k % 3 == 0, "old").otherwise(F.col("n_name")), 256).alias("sha256"), F.when(k % 7 == 1, "unsafe_path").alias("problem"))
    actual = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    return audit.audit_manifest(listed, actual)


def units_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 40 == 1, "g").otherwise("mg").alias("unit"))
    return audit.single_unit(o, ["o_custkey"], "unit").select("o_custkey", F.array_join("units", ",").alias("units"))


def parameter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("a=1; b = "), k, F.when(k % 3 == 0, "; a=2").otherwise(""), F.when(k % 4 == 0, "; broken").otherwise(";")).alias("p"))
    return audit.parameter_issues(n, "n_nationkey", "p")


def stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 3).alias("expected"))
    cells = n.select(F.lit("all").alias("g"), "expected", F.col("expected").alias("complete"), F.lit(0).alias("failed"))
    short = cells.withColumn("complete", F.lit(1))
    return metrics.may_stop(cells).withColumn("case", F.lit("whole")).union(metrics.may_stop(short).withColumn("case", F.lit("short"))).union(metrics.may_stop(cells.limit(0)).withColumn("case", F.lit("empty")))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("stage"), (F.col("n_nationkey") % 3).alias("file"), "n_name")
    known = spark.createDataFrame([(0, 0, "data"), (0, 1, "model"), (2, 2, "data")], "stage int, file int, section string")
    return release.routed(facts, known).groupBy("section").agg(F.count("*").alias("n"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("x"), (F.col("value") * 2).alias("y"), (F.col("event_id") * 1.0).alias("z"))
    got = release.box_centre(e, ["event_type"])
    return got.select("event_type", *[F.round(c, 4).alias(c) for c in "xyz"])


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    present = F.array_compact(F.array(F.when(k % 2 == 0, "a"), F.when(k % 3 == 0, "b"), F.when(k % 5 == 0, "unknown")))
    return table(spark, sf_dir, "part").select("p_partkey", learning.indicator_score(present, {"a": 1.5, "b": -0.25}, 2.0).alias("score"))


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.lit('{"b":1,"k":2}')).otherwise(F.lit('{"k":2}')).alias("j"))
    return e.select(canon.same_keys("j", ["k", "b"]).alias("same")).groupBy("same").agg(F.count("*").alias("n"))


def dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("a"), F.substring(F.lit("‐‑‒–—−"), F.col("n_nationkey") % 6 + 1, F.lit(1)), F.lit("b")).alias("t"))
    return n.select("n_nationkey", text.folded_dashes("t").alias("t"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [F.col("o_orderstatus") == "O", F.col("o_orderpriority").startswith("1"), F.col("o_orderkey") % 2 == 0]
    return table(spark, sf_dir, "orders").select(values.any_of(rules).alias("any"), values.all_of(rules).alias("all")).groupBy("any", "all").agg(F.count("*").alias("n"))


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("at"), F.when(F.col("event_id") % 4 != 0, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("due"))
    return e.select(narrative.past_deadline("at", "due").alias("late")).groupBy("late").agg(F.count("*").alias("n"))


QUERIES = {
    "q_v28_locators": locators, "q_w02_ascending": ascending, "q_d19_scope": scope, "q_d19_scope_replay": scope_replay, "q_a08_scope_counters": counters, "q_d20_bridge": bridge, "q_d20_candidate_decisions": candidate_decisions,
    "q_d20_fixes": native_fixes, "q_v49_consumption": consumption, "q_d30_replay": replayed_ledger, "q_d29_obligations": gap_obligations, "q_v51_contract_status": contract, "q_v15_inferred_units": unit_receipts, "q_v53_tokens": tokens, "q_v35_protected": protected,
    "q_v22_record_digests": record_digests, "q_v26_slots": slots, "q_j09_support": supported, "q_v24_resolutions": resolutions, "q_d23_material_routes": material_routes, "q_d23_finish": finished, "q_v08_packets": packets, "q_d24_attached": attached,
    "q_f03_narratives": narratives, "q_f11_points": points, "q_f13_brackets": brackets, "q_v03_containment": containment, "q_f09_labels": labels, "q_f01_registry_numbers": registry_numbers, "q_v01_anchored": anchored, "q_v07_evidence": evidence, "q_v02_terminals": terminals,
    "q_v06_notices": notices, "q_v18_label_rules": label_rules, "q_v11_lineages": lineages, "q_v17_replays": replays, "q_d25_manifest": manifest_audit, "q_a30_units": units_alone, "q_f30_parameters": parameter_lists, "q_v47_may_stop": stopping, "q_p25_routes": routes,
    "q_g03_centres": centres, "q_v54_indicators": indicators, "q_f42_same_keys": json_keys, "q_f15_dashes": dashes, "q_p01_filters": filters, "q_f33_deadlines": deadlines,
}

_K = "o_orderkey"
_NARRATED_SQL = """(CASE WHEN k % 13 = 0 THEN '' ELSE 'LD50 ' END || CASE WHEN k % 2 = 0 THEN 'Rat' ELSE 'rats' END || ' ' || ['oral', 'GAVAGE', 'po', 'skin'][k % 4 + 1] || ['', ' (male)', ' (gavage)', ' (old)'][k // 4 % 4 + 1]
      || [' ', ' >= ', ' <', ' = '][k // 3 % 4 + 1] || CASE k % 5 WHEN 0 THEN '1,234' WHEN 1 THEN '12,34' ELSE k || '.5' END || ' mg/kg' || CASE WHEN k % 3 = 0 THEN ' bw.' ELSE '' END
      || CASE WHEN k % 7 = 0 THEN ' [Smith, 3 mg/kg]' ELSE ' [Smith]' END || CASE WHEN k % 6 = 0 THEN ' **PEER REVIEWED**' ELSE '' END)"""
ORACLE = {
    "q_v28_locators": f"""WITH {_LINES}, c AS (SELECT l_orderkey AS a, CASE WHEN p % 11 = 1 THEN l_linenumber + 100 ELSE l_linenumber END AS b, CASE WHEN p % 7 = 2 THEN 'x' ELSE d END AS d FROM n WHERE p % 5 <> 0),
      g AS (SELECT a, b, count(*) AS k, min(d) AS lo, max(d) AS hi FROM (SELECT * FROM c UNION ALL SELECT * FROM c WHERE a % 9 = 0) GROUP BY 1, 2)
      SELECT a AS l_orderkey, b::BIGINT AS l_linenumber, problem FROM (SELECT a, b, CASE WHEN n.d IS NULL THEN 'unknown_locator' WHEN k > 1 THEN 'repeated_locator' WHEN lo <> n.d OR hi <> n.d THEN 'digest_mismatch' END AS problem FROM g LEFT JOIN n ON a = l_orderkey AND b = l_linenumber) WHERE problem IS NOT NULL""",
    "q_w02_ascending": """SELECT position FROM (SELECT o_orderkey AS position, o_orderkey % 13 AS s, o_orderkey % 4 AS t, lag(o_orderkey % 13) OVER w AS ls, lag(o_orderkey % 4) OVER w AS lt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE s < ls OR (s = ls AND t <= lt)""",
    "q_d19_scope": f"WITH {_SCOPED} SELECT exact, relevant, count(*) AS n FROM s GROUP BY 1, 2",
    "q_d19_scope_replay": f"""WITH {_SCOPED}, c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 14 = 5 THEN NOT exact ELSE exact END AS e FROM s WHERE o_orderkey % 10 <> 3)
      SELECT o_orderkey, 'missing' AS problem FROM s WHERE o_orderkey % 10 = 3 UNION ALL SELECT -k, 'unexpected' FROM c WHERE k % 25 = 2 UNION ALL SELECT k, 'repeated' FROM c WHERE k % 22 = 1
      UNION ALL SELECT k, 'flags_differ' FROM c JOIN s ON k = o_orderkey WHERE e <> exact AND k % 22 <> 1""",
    "q_a08_scope_counters": f"WITH {_SCOPED} SELECT 'primary' AS role, count(*) AS n, true AS has_digest FROM s UNION ALL SELECT 'exact', count(*), true FROM s WHERE exact UNION ALL SELECT 'union', count(*), true FROM s WHERE relevant UNION ALL SELECT 'none', 0, false",
    "q_d20_bridge": f"""WITH {_SCOPED}, e AS (SELECT o_orderkey AS k, exact, o_orderkey % 4 = 0 AS shown, o_orderkey % 5 = 1 AS rev, o_orderkey % 5 = 2 AS term, o_orderkey % 5 >= 3 OR o_orderkey % 30 = 1 AS cand FROM s WHERE relevant AND o_orderkey % 17 <> 1)
      SELECT * FROM (SELECT o_orderkey, 'missing' AS problem FROM s WHERE relevant AND o_orderkey % 17 = 1
      UNION ALL SELECT k, CASE WHEN rev::INT + term::INT + cand::INT > 1 THEN 'branches_overlap' WHEN NOT rev AND NOT term AND NOT cand THEN 'no_branch' WHEN NOT cand AND shown THEN 'hides_a_number' WHEN NOT cand AND NOT term AND exact THEN 'exact_without_candidates' END FROM e) WHERE problem IS NOT NULL""",
    "q_d20_candidate_decisions": """WITH c AS (SELECT p_partkey AS k, p_size::VARCHAR AS o, (p_size + 100)::VARCHAR AS u FROM part), d AS (SELECT k, o, u, CASE WHEN k % 10 = 0 THEN 'excluded' WHEN k % 10 = 1 THEN 'later' ELSE 'preserve' END AS disp,
        CASE WHEN k % 7 = 3 THEN '1e9' WHEN k % 2 = 0 THEN o ELSE u END AS num, CASE WHEN k % 2 = 0 OR k % 5 = 2 THEN 'mg' ELSE 'g' END AS unit FROM c WHERE k % 19 <> 0)
      SELECT * FROM (SELECT k AS candidate_id, 'missing' AS problem FROM c WHERE k % 19 = 0
      UNION ALL SELECT k, CASE WHEN disp = 'later' THEN 'unknown_disposition' WHEN disp = 'excluded' AND k % 20 <> 0 THEN 'unapproved_clause' WHEN num NOT IN (o, u) THEN 'unsupported_value'
        WHEN NOT ((num = u AND unit = 'g') OR (num = o AND unit = 'mg')) THEN 'mixed_values' WHEN disp = 'preserve' AND k % 6 = 0 AND k % 12 = 6 THEN 'inequality_erased' END FROM d) WHERE problem IS NOT NULL""",
    "q_d20_fixes": """WITH c AS (SELECT c_custkey AS k, c_mktsegment = 'BUILDING' AS b, c_nationkey = 4 AS n FROM customer), w AS (SELECT k, unnest(list_concat(CASE WHEN b THEN [1, 2] ELSE [] END, CASE WHEN n THEN [3] ELSE [] END)) AS f FROM c),
      d AS (SELECT k, unnest(CASE k % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [3] ELSE [] END) AS f FROM c)
      SELECT k AS candidate_id, f AS fix_id, 'omitted' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM d) UNION ALL SELECT k, f, 'extra' FROM (SELECT * FROM d EXCEPT SELECT * FROM w)""",
    "q_v49_consumption": """WITH u AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS ex, NOT ((s_suppkey % 3 = 0 AND s_suppkey % 4 <> 2) OR s_suppkey % 7 = 1) AS out FROM supplier WHERE s_suppkey % 8 <> 1), o AS (SELECT k // 2 AS h FROM u WHERE out GROUP BY 1 HAVING count(*) > 1)
      SELECT * FROM (SELECT s_suppkey AS candidate_id, 'missing' AS problem FROM supplier WHERE s_suppkey % 8 = 1 UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN 'decision_differs' WHEN ex AND out THEN 'excluded_emits' WHEN NOT ex AND NOT out THEN 'preserved_without_output' END FROM u
      UNION ALL SELECT k, 'output_repeated' FROM u JOIN o ON k // 2 = h WHERE out) WHERE problem IS NOT NULL""",
    "q_d30_replay": "SELECT o_orderstatus, o_orderpriority, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 5 = 2 THEN 'second' ELSE 'first' END AS side, count(*) AS times FROM orders WHERE o_orderkey % 5 IN (2, 3) GROUP BY 1, 2, 3, 4",
    "q_d29_obligations": """SELECT n_regionkey::VARCHAR AS source_id, count(*) AS owed, count(*) FILTER (WHERE n_nationkey % 3 = 0 OR n_regionkey = 1) AS met,
      CASE WHEN count(*) = count(*) FILTER (WHERE n_nationkey % 3 = 0 OR n_regionkey = 1) THEN 'closed' WHEN count(*) FILTER (WHERE n_nationkey % 3 = 0 OR n_regionkey = 1) > 0 THEN 'partial' ELSE 'open' END AS status FROM nation GROUP BY 1, n_regionkey""",
    "q_v51_contract_status": """SELECT n_name AS source_id, CASE WHEN n_nationkey % 2 = 0 AND (n_nationkey % 7 = 0 OR n_nationkey % 5 = 0) THEN 'blocked' WHEN n_nationkey % 7 = 0 OR n_nationkey % 3 > 0 OR n_nationkey % 5 = 0 THEN 'limited' ELSE 'produced' END AS status FROM nation""",
    "q_v15_inferred_units": """SELECT n_name AS path, CASE WHEN n_nationkey % 4 > 1 AND n_name NOT LIKE 'I%' THEN 'mg/kg' END AS unit,
      CASE WHEN n_nationkey % 4 = 0 THEN 'no_receipt' WHEN n_nationkey % 4 = 1 THEN 'receipt_for_another_hash' WHEN n_name LIKE 'I%' THEN 'several_receipts' END AS problem FROM nation""",
    "q_v53_tokens": """SELECT stage, problem FROM (SELECT n_name AS stage, CASE WHEN n_nationkey % 5 = 2 AND n_nationkey % 6 = 1 THEN NULL WHEN n_nationkey % 5 = 2 THEN 'not_accepted' WHEN n_nationkey % 6 = 1 THEN 'unknown_stage' WHEN n_nationkey % 4 = 3 THEN 'stale_token' END AS problem FROM nation) WHERE problem IS NOT NULL""",
    "q_v35_protected": """SELECT 'kinds[0]' AS path, event_type AS value, count(*) AS n FROM events WHERE event_type = 'purchase' AND props IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'used.ref', '3', count(*) FROM events WHERE json_extract_string(props, '$.k') = '3' HAVING count(*) > 0""",
    "q_v22_record_digests": "SELECT * FROM (VALUES (1, 'no_digest'), (2, 'invalid_digest'), (3, 'digest_mismatch')) v(r_regionkey, problem)",
    "q_v26_slots": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS bodies FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
    "q_j09_support": """WITH s AS (SELECT s_suppkey % 5 AS st, s_nationkey AS c, s_suppkey % 4 = 0 AS b FROM supplier), m AS (SELECT c_custkey, st FROM customer JOIN s ON c_nationkey = c UNION ALL SELECT c_custkey, st FROM customer JOIN s ON b WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING')
      SELECT c_custkey AS observation_id, string_agg(DISTINCT st::VARCHAR, ',' ORDER BY st::VARCHAR) AS structures, count(*) AS n_support FROM m GROUP BY 1""",
    "q_v24_resolutions": """SELECT k AS material_id, CASE WHEN k % 5 > 1 AND k % 11 = 7 THEN 'unknown_outcome' WHEN k % 9 = 4 THEN 'no_evidence' WHEN k % 8 = 2 THEN 'no_rationale' ELSE 'not_independent' END AS problem
      FROM (SELECT c_custkey AS k FROM customer) WHERE (k % 5 > 1 AND k % 11 = 7) OR k % 9 = 4 OR k % 8 = 2 OR k % 7 = 3""",
    "q_d23_material_routes": """WITH r AS (SELECT k, CASE WHEN k % 5 < 2 OR k % 27720 = 12 THEN 'hold' ELSE 'verified' END AS s FROM (SELECT c_custkey AS k FROM customer) WHERE NOT ((k % 5 > 1 AND k % 11 = 7) OR k % 9 = 4 OR k % 8 = 2 OR k % 7 = 3)),
      o AS (SELECT o_orderkey % 6 = 0 AS own, s FROM orders LEFT JOIN r ON o_custkey = k)
      SELECT CASE WHEN own THEN 'excluded' WHEN s = 'verified' THEN 'retained' WHEN s = 'hold' THEN 'quarantined' ELSE 'pending' END AS disposition, CASE WHEN own THEN 'r' WHEN s = 'hold' THEN 'material_on_hold' WHEN s IS NULL THEN 'material_pending' END AS reason, count(*) AS n FROM o GROUP BY 1, 2""",
    "q_d23_finish": "SELECT problem, n FROM (SELECT 'missing' AS problem, count(*) AS n FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'repeated', count(*) FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 16 = 1) WHERE n > 0",
    "q_v08_packets": """WITH p AS (SELECT n_nationkey % 3 AS packet, n_nationkey % 4 AS alias, 'f' || n_nationkey % 6 AS path, CASE WHEN n_nationkey = 13 THEN 99 ELSE n_nationkey % 6 END AS h FROM nation)
      SELECT path, 'digest_conflict' AS problem FROM p GROUP BY 1 HAVING count(DISTINCT h) > 1 UNION ALL SELECT DISTINCT min(path), 'alias_conflict' FROM p GROUP BY packet, alias HAVING count(DISTINCT path) > 1""",
    "q_d24_attached": """WITH o AS (SELECT o_custkey * CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE 1 END AS f, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
      SELECT problem, count(*) AS n FROM (SELECT CASE WHEN f < 0 THEN 'unaccounted' WHEN n > 1 THEN 'repeated' ELSE 'attached' END AS problem FROM o) GROUP BY 1""",
    "q_f03_narratives": rf"""WITH t AS (SELECT o_orderkey AS k, {_NARRATED_SQL} AS t FROM orders), w AS (SELECT *, k // 4 % 4 AS note, k % 4 AS r, CASE WHEN k % 13 = 0 THEN 'no_ld50_mention' WHEN k % 5 = 1 OR k % 4 = 3 THEN 'narrative_not_verified_single_rat_oral_scalar'
        WHEN k // 4 % 4 = 3 OR (k // 4 % 4 = 2 AND k % 4 <> 0) THEN 'unverified_parenthetical_context' WHEN k % 7 = 0 THEN 'ambiguous_bracketed_dose_context' END AS why FROM t)
      SELECT k, CASE WHEN why IS NULL THEN CASE WHEN k % 2 = 0 THEN 'Rat' ELSE 'rats' END ELSE '' END AS species, CASE WHEN why IS NULL THEN ['oral', 'GAVAGE', 'po', 'skin'][r + 1] ELSE '' END AS route, CASE WHEN why IS NULL AND note = 1 THEN 'male' ELSE '' END AS note,
        CASE WHEN why IS NULL THEN ['unknown', '>=', '<', '='][k // 3 % 4 + 1] ELSE '' END AS relation, CASE WHEN why IS NULL THEN CASE WHEN k % 5 = 0 THEN '1234' ELSE k || '.5' END ELSE '' END AS value,
        CASE WHEN why IS NULL THEN 'mg/kg' || CASE WHEN k % 3 = 0 THEN ' bw' ELSE '' END ELSE '' END AS unit, CASE WHEN k % 13 = 0 THEN 'excluded' WHEN why IS NULL THEN 'candidate' ELSE 'quarantined' END AS status, why FROM w""",
    "q_f11_points": "SELECT n_nationkey, [NULL, NULL, 'composite', 'composite', 'composite', 'composite', 'embedded', 'embedded', 'embedded', 'embedded', NULL, 'composite'][n_nationkey % 12 + 1] AS problem FROM nation",
    "q_f13_brackets": """WITH p AS (SELECT p_partkey % 7 AS i, p_partkey % 3 < 2 AND p_partkey % 5 <> 0 AS t FROM part)
      SELECT ['[a]', '[a][b]', '[a[b]c]', 'a]', '[a', '[]', '[[a]'][i + 1] AS q, i IN (0, 2, 5) AS whole, i IN (0, 2, 5) AND t AS terminal, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "q_v03_containment": "SELECT o_orderkey % 4 > 0 AND o_orderkey % 7 <= o_orderkey % 11 AND o_orderkey % 11 + o_orderkey % 4 <= o_orderkey % 7 + 10 AS held, count(*) AS n FROM orders GROUP BY 1",
    "q_f09_labels": "SELECT n_nationkey, n_nationkey % 3 <> 1 AS panels, CASE WHEN n_nationkey % 2 = 0 THEN 'S' || n_nationkey END AS as_table, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey::VARCHAR END AS as_figure, n_nationkey % 2 = 1 AS key, n_nationkey % 2 = 0 AS digest FROM nation",
    "q_f01_registry_numbers": """WITH p AS (SELECT p_partkey AS k, CASE WHEN length(p_partkey::VARCHAR) > 5 THEN left(p_partkey::VARCHAR, 5) ELSE lpad(p_partkey::VARCHAR, 5, '1') END AS b FROM part),
      s AS (SELECT k, list_sum(list_transform(generate_series(1, 5), lambda i: i * b[6 - i]::INT)) % 10 AS own, list_sum(list_transform(generate_series(1, 5), lambda i: (i + 1) * b[6 - i]::INT)) % 10 AS other FROM p)
      SELECT k AS p_partkey, k % 3 = 0 OR own = other AS valid FROM s""",
    "q_v01_anchored": "SELECT n_nationkey, sha256('[\"' || n_name || '\",\"' || n_regionkey || '\"]') AS id FROM nation",
    "q_v07_evidence": "SELECT CASE WHEN n_nationkey % 7 = 3 THEN n_nationkey * 100 ELSE n_nationkey END AS field_id, CASE WHEN n_nationkey % 7 = 3 THEN 'unknown_field' ELSE 'quote_mismatch' END AS problem FROM nation WHERE n_nationkey % 7 = 3 OR n_nationkey % 4 = 1",
    "q_v02_terminals": """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 3 = 2 THEN 'unknown_clause' WHEN (s_suppkey % 3 = 0) <> (s_suppkey % 2 = 0) THEN 'clause_disposition_mismatch' WHEN s_suppkey % 2 = 1 AND s_suppkey % 5 = 0 THEN 'fewer_than_two_alternatives' END AS problem FROM supplier) WHERE problem IS NOT NULL GROUP BY 1""",
    "q_v06_notices": "SELECT n_nationkey AS notice_id, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['b', n_name] ELSE ['a', 'b'] END) AS member FROM nation",
    "q_v18_label_rules": "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'label' WHEN event_id % 7 = 0 THEN 'probability' WHEN event_id % 5 = 0 THEN 'threshold' END AS problem FROM events) WHERE problem IS NOT NULL GROUP BY 1",
    "q_v11_lineages": "SELECT c_custkey, 2::BIGINT AS kinds FROM customer WHERE c_custkey % 6 = 0",
    "q_v17_replays": "SELECT event_id FROM events WHERE event_id % 5 = 0 OR (event_id % 3 = 0 AND abs(0.001) > 1e-9::DOUBLE + 1e-7::DOUBLE * abs(value + 0.001)) OR value IS NULL",
    "q_d25_manifest": """WITH l AS (SELECT n_nationkey AS k, n_name AS p FROM nation WHERE n_nationkey % 5 <> 0) SELECT 'manifest' AS gate, 'blocker' AS severity, 'manifest_entry' AS code, k || ':unsafe_path' AS detail FROM l WHERE k % 7 = 1
      UNION ALL SELECT 'manifest', 'blocker', CASE WHEN n_nationkey % 4 = 0 THEN 'extra' ELSE 'stale' END || '_manifest_entry', n_name FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 1 AND (n_nationkey % 4 = 0 OR n_nationkey % 3 = 0)
      UNION ALL SELECT 'manifest', 'blocker', 'missing_manifest_entry', n_name FROM nation WHERE (n_nationkey % 5 = 0 OR n_nationkey % 7 = 1) AND n_nationkey % 4 <> 0""",
    "q_a30_units": "SELECT o_custkey, 'g,mg' AS units FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 40 = 1) AND bool_or(o_orderkey % 40 <> 1)",
    "q_f30_parameters": "SELECT n_nationkey, 'duplicate' AS issue FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 'malformed' FROM nation WHERE n_nationkey % 4 = 0",
    "q_v47_may_stop": "SELECT * FROM (VALUES (true, 'whole'), (false, 'short'), (false, 'empty')) v(stop, \"case\")",
    "q_p25_routes": """SELECT CASE WHEN n_regionkey = 0 AND n_nationkey % 3 = 0 OR n_regionkey = 2 AND n_nationkey % 3 = 2 THEN 'data' WHEN n_regionkey = 0 AND n_nationkey % 3 = 1 THEN 'model' ELSE 'unrouted' END AS section, count(*) AS n FROM nation GROUP BY 1""",
    "q_g03_centres": "SELECT event_type, round(avg(value), 4) AS x, round(avg(value * 2), 4) AS y, round(avg(event_id * 1.0::DOUBLE), 4) AS z FROM events GROUP BY 1",
    "q_v54_indicators": "SELECT p_partkey, (2 + CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 0 END - CASE WHEN p_partkey % 3 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS score FROM part",
    "q_f42_same_keys": "SELECT event_id % 3 = 0 AS same, count(*) AS n FROM events GROUP BY 1",
    "q_f15_dashes": "SELECT n_nationkey, 'a-b' AS t FROM nation",
    "q_p01_filters": """SELECT o_orderstatus = 'O' OR o_orderpriority LIKE '1%' OR o_orderkey % 2 = 0 AS "any", o_orderstatus = 'O' AND o_orderpriority LIKE '1%' AND o_orderkey % 2 = 0 AS "all", count(*) AS n FROM orders GROUP BY 1, 2""",
    "q_f33_deadlines": "SELECT CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 10 = 0 THEN true ELSE ts > TIMESTAMP '2024-01-15' END AS late, count(*) AS n FROM events GROUP BY 1",
}
