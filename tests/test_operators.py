import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attesta.functions import canon, chemistry, text, values
from attesta.operators import audit, components, curation, joins, learning, metrics, ordered, reconcile, release, splits
from attesta.plans.contract import ContractError, CurationContract, Task
from attesta.plans.staging import Staging
from attesta.streaming import lifecycle

MAP = {"cas": "casrn", "species": "species", "route": "route", "endpoint": "endpoint_type", "value": "numeric_value", "unit": "numeric_unit", "smiles": "smiles", "relation": "qualifier"}
TASK = (Task("t", "rat", "oral", "LD50"),)


def run(spark, rows, support=(), **options):
    df = spark.createDataFrame(rows, "row_id string, casrn string, species string, route string, endpoint_type string, numeric_value string, numeric_unit string, smiles string, qualifier string")
    sup = spark.createDataFrame(list(support), "cas string, structure string, weight double")
    return curation.curate(df, CurationContract(MAP, TASK, **options), sup)


def row(i, **k):
    base = dict(cas="64-17-5", species="Rat", route="ORAL", ep="ld50", value="100", unit="mg/kg", smiles="CCO", q="=") | k
    return (str(i), base["cas"], base["species"], base["route"], base["ep"], base["value"], base["unit"], base["smiles"], base["q"])


def test_units_relations_and_invalid_numbers(spark):
    rows = [row(1), row(2, value="100000", unit="ug/kg"), row(3, value="0.1", unit="g/kg"), row(4, value="0.1", unit="mol/kg"), row(5, unit="mg/kg/day"), row(6, q=""), row(7, q="<"), row(8, value="1_000"), row(9, value="NaN"), row(10, value="-1")]
    sup = [("64-17-5", "CCO", 46.0)]
    got = run(spark, rows, sup)
    kept = {r.row_id: round(r.target_mg_kg, 6) for r in got.retained.collect()}
    assert kept == {"1": 100, "2": 100, "3": 100, "4": 4600}
    why = {r.row_id: (r.disposition, r.reasons) for r in got.dispositions.collect()}
    assert why["5"] == ("excluded", ["unsupported_or_unknown_unit"]) and why["6"] == ("excluded", ["nonexact_or_unknown_relation"])
    assert why["8"][1] == why["9"][1] == why["10"][1] == ["invalid_positive_numeric_value"]
    loose = {r.row_id: r.target_kind for r in run(spark, rows, sup, relation_policy="reported_numeric").retained.collect()}
    assert loose["6"] == "reported_numeric_estimate" and "7" not in loose
    assert got.retained.where("replicate_flag").count() == 4


def test_identity_outcomes(spark):
    sup = [("64-17-5", "CCO", 46.0), ("64-17-5", "CCO", 46.0), ("71-43-2", "c1", 78.0), ("71-43-2", "c2", 78.0), ("67-56-1", "CO", 32.0), ("67-56-1", "", 32.0)]
    rows = [row(1, smiles=""), row(2, smiles="", cas="71-43-2"), row(3, smiles="", cas="67-56-1"), row(4, smiles="CCC"), row(5, smiles="", cas="64-17-6"), row(6)]
    got = run(spark, rows, sup)
    status = {r.row_id: r.status for r in got.identities.collect()}
    assert status == {"1": "exact_identifier_mapping", "2": "ambiguous_identity", "3": "unresolved_support_identity", "4": "identity_conflict", "5": "unresolved_identity", "6": "direct_source"}
    d = {r.row_id: (r.disposition, r.flags) for r in got.dispositions.collect()}
    assert [d[k][0] for k in "123456"] == ["retained", "quarantined", "quarantined", "quarantined", "quarantined", "retained"] and d["5"][1] == ["invalid_cas"]


def test_contract_errors(spark):
    with pytest.raises(ContractError):
        CurationContract({"nonsense": "x"}, TASK)
    with pytest.raises(ContractError):
        CurationContract(MAP, TASK, relation_policy="any")
    with pytest.raises(PySparkException):
        run(spark, [row(1)], constants={"species": "mouse"}).dispositions.collect()


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_sums_and_quantile(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.randint(0, 9)) for i in r.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(x.g, x.o): x.s for x in ordered.running_sums(df, ["g"], [F.col("o")], {"s": "v"}).collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}
    for q in (0.0, 0.05, 0.5, 1.0):
        want = {g: sorted(v for h, _, v in rows if h == g) for g in "ab"}
        assert {x.g: x.quantile for x in metrics.lower_quantile(df, ["g"], "v", q).collect()} == {g: v[int((len(v) - 1) * q)] for g, v in want.items()}


def test_metrics_undefined_reasons(spark):
    df = spark.createDataFrame([("one", 1, 0.9, 2.0), ("one", 1, 0.1, 2.0), ("two", 0, 0.1, 1.0), ("two", 1, 0.2, 3.0)], "g string, y int, p double, v double")
    c = {r.g: r for r in metrics.confusion(df, ["g"], "y", "p", F.lit(0.5)).collect()}
    assert c["one"].specificity is None and c["one"].specificity_undefined_reason == "no_negative_targets" and c["one"].mcc_undefined_reason == "single_class_target"
    assert c["two"].mcc_undefined_reason == "single_class_prediction" and c["two"].balanced_accuracy == 0.5
    k = {r.g: r for r in metrics.ranking(df, ["g"], "y", "p").collect()}
    assert k["one"].roc_auc is None and k["one"].ranking_undefined_reason == "single_class_target" and k["two"].roc_auc == 1.0
    m = {r.g: r for r in metrics.regression(df, ["g"], "v", "p").collect()}
    assert m["one"].r2 is None and m["one"].r2_undefined_reason == "constant_target_or_single_row" and m["two"].r2 is not None


def test_bootstrap_draws_repeat_and_cover(spark):
    d = metrics.draws(["b", "a", "c"], 50, 7)
    assert d == metrics.draws(["c", "b", "a"], 50, 7) and all(sum(t for k, _, t in d if k == rep) == 3 for rep in range(50))
    rng = np.random.default_rng(3)
    rows = [("abc"[i % 3], float(v), float(v + e)) for i, (v, e) in enumerate(zip(rng.normal(size=60), rng.normal(size=60), strict=True))]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r.metric: r for r in metrics.bootstrap_intervals(df, "g", "y", "p", spark.createDataFrame(d, "rep int, g string, times long")).collect()}
    maes = []
    for rep in range(50):
        picked = [(y, p) for k, g, t in d if k == rep for h, y, p in rows if h == g for _ in range(t)]
        maes.append(np.mean([abs(y - p) for y, p in picked]))
    assert got["mae"].valid == 50 and got["mae"].lower == pytest.approx(np.quantile(maes, 0.025)) and got["mae"].upper == pytest.approx(np.quantile(maes, 0.975))


def test_splits_are_group_safe(spark):
    rows = spark.createDataFrame([(f"r{i}", f"g{i % 12}", f"k{i % 6}") for i in range(60)], "row_id string, declared string, key string")
    ids = {r.row_id: r.effective_group_id for r in splits.connected_groups(rows, "parent", "row_id", "declared", "key").collect()}
    assert len(set(ids.values())) == 6 and all(v.startswith("parent:") for v in ids.values())
    import hashlib

    assert ids["r0"] == "parent:" + hashlib.sha256(json.dumps(["k0"], separators=(",", ":")).encode()).hexdigest()
    held = splits.terminal_holdout(rows, "declared", 9, 0.25).select("declared", "partition").distinct().collect()
    order = sorted({f"g{i}" for i in range(12)}, key=lambda g: (hashlib.sha256(json.dumps([9, "terminal", g], separators=(",", ":")).encode()).hexdigest(), g))
    assert {r.declared for r in held if r.partition == "terminal"} == set(order[:3]) and len(held) == 12
    nested = splits.nested_folds(rows, "declared", 3, 2, 9, "t").collect()
    inner = [r for r in nested if r.inner_of is not None]
    assert all(r.inner_of != r.outer_fold for r in inner) and len(inner) == 24
    with pytest.raises(splits.InfeasibleSplit):
        splits.fold_of(rows, "declared", 13, 1, "x")
    whole = splits.prepare_splits(rows.withColumn("task", F.lit("t")), "row_id", "declared", "task", ["t"], 9, 0.25, 3, 2).collect()
    assert {r.row_id for r in whole} == {f"r{i}" for i in range(60)} and sum(r.partition == "terminal" for r in whole) == 15
    assert all(sum(r.row_id == "r0" and r.inner_of == k for r in whole) <= 1 for k in range(3))
    folds = splits.stratified_folds([(f"g{i}", i % 3, 1) for i in range(12)], 3, 4)
    assert sorted(folds.values()).count(0) == 4 and set(folds.values()) == {0, 1, 2}


def test_no_leakage_from_validation_labels(spark):
    rng = np.random.default_rng(910)
    x = rng.normal(size=(24, 2))
    rows = [(i, i % 3, float(a), None if i == 1 else float(b), float(2 * a + (b if i != 1 else 0))) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, fold int, a double, b double, y double")
    make = lambda: learning.pipeline(["a", "b"], learning.estimator("ridge", alpha=0.01), "y")
    one = {r.id: r.prediction for r in learning.out_of_fold(df, 3, "fold", make, "id").collect()}
    assert len(one) == 24
    other = df.withColumn("y", F.when(F.col("fold") == 0, F.lit(1e6)).otherwise(F.col("y")))
    two = {r.id: r.prediction for r in learning.out_of_fold(other, 3, "fold", make, "id").collect()}
    assert all(one[i] == two[i] for i in one if i % 3 == 0) and any(abs(one[i] - two[i]) > 1 for i in one if i % 3)
    with pytest.raises(learning.DependencyUnavailable):
        learning.estimator("xgboost")
    assert learning.candidates({"a": [1, 2], "b": [3, 4]}, 3, 1) == learning.candidates({"b": [3, 4], "a": [1, 2]}, 3, 1)


def test_join_classes_and_comparisons(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    got = {r.k: (r.match_class, [m.v for m in r.matches or []]) for r in joins.cardinality_join(left, right, ["k"], ["v"]).collect()}
    assert got == {1: ("unique", ["a"]), 2: ("ambiguous", ["b", "c"]), 3: ("missing", [])}
    problems = reconcile.membership_problems(left, spark.createDataFrame([(1,), (1,), (9,)], "k int"), "k").collect()
    assert {r.k: r.problem for r in problems} == {1: "repeated", 2: "missing", 3: "missing", 9: "outside"}
    with pytest.raises(ValueError):
        reconcile.fail_on(left, "left over")
    a = spark.createDataFrame([("g", i, str(i)) for i in range(200)], "g string, o int, m string")
    one = reconcile.ordered_digest(a, ["g"], F.col("m"), ["o"]).collect()
    assert one == reconcile.ordered_digest(a.repartition(7), ["g"], F.col("m"), ["o"]).collect() and one[0].n == 200
    assert one[0].digest != reconcile.ordered_digest(a.where("o <> 5"), ["g"], F.col("m"), ["o"]).collect()[0].digest


@pytest.mark.parametrize(("body", "numbers", "problem"), [("1, 3-5;7", [1, 3, 4, 5, 7], None), ("5-3", [], "descending"), ("2, 5-3, 9", [2], "descending"), ("1,,2", [], "malformed"), ("1-20000", [], "too_large"), ("4–6", [4, 5, 6], None)])
def test_citations(spark, body, numbers, problem):
    n, why = text.expand_citation(F.lit(body))
    got = spark.range(1).select(n.alias("n"), why.alias("w")).first()
    assert (list(got.n), got.w) == (numbers, problem)


@pytest.mark.parametrize(("body", "labels"), [("Figure 2", ["2"]), ("figs. S1-S3", ["S1", "S2", "S3"]), ("Figures 1, 3 and 5a", ["1", "3", "5"]), ("Fig 4 to 6", ["4", "5", "6"]), ("Figs. S2–4", ["S2", "S3", "S4"]), ("prefigure 3x", [])])
def test_label_references(spark, body, labels):
    got = spark.range(1).select(text.label_references(F.lit(body)).alias("x")).first().x
    assert got == labels


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(values.valid_cas(F.lit("64-17-5"))) and not one(values.valid_cas(F.lit("64-17-6"))) and not one(values.valid_cas(F.lit("59")))
    assert one(text.column_index(F.lit("AB"))) == 28
    assert one(text.span_holds(F.lit("a😀bc"), F.lit(1), F.lit(3), F.lit("😀b"))) and not one(text.span_holds(F.lit("abc"), F.lit(2), F.lit(9), F.lit("c")))
    assert one(text.strict_utc(F.lit("2024-02-29T00:00:00Z"))) and not one(text.strict_utc(F.lit("2023-02-29T00:00:00Z"))) and not one(text.strict_utc(F.lit("2024-01-01T00:00:00")))
    assert one(text.html_escaped(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    m, issues = text.parameters(F.lit("a=1; b = 2;a=3; junk"))
    assert one(m) == {"a": "1", "b": "2"} and one(issues) == ["duplicate", "malformed"]
    p, q, why = values.effect_point(F.lit("5"), F.lit(None), F.lit(">"), F.lit(""))
    assert (one(p), one(q), one(why)) == ("5", ">", None)
    assert one(values.effect_point(F.lit("5"), F.lit("6"), F.lit(""), F.lit(""))[2]) == "interval_not_point"
    assert one(canon.canonical_json(F.lit('{"b": 1, "a": "é"}'))) == '{"a":"é","b":1}'
    assert one(canon.json_pointer(F.lit('{"a/b": [1, {"c": "x"}]}'), F.lit("/a~1b/1/c"))) == "x"
    for bad in ('{"a":1,"a":2}', "[NaN]", "[1e999]"):
        with pytest.raises(ValueError):
            canon.strict_loads(bad)
    assert canon.canonical({"a": "é"}, ascii_only=True, spaced=True) == '{"a": "\\u00e9"}'


def test_audits_and_gates(spark):
    blocks = spark.createDataFrame([("d", 1, "As in [1-2] and Figs. 1 and 3; Table 1."), ("d", 2, "Figure 1. Caption"), ("d", 3, "Figure 3. Caption"), ("d", 4, "Figure 3. Again"), ("d", 5, "bad [5-4]")], "path string, block int, text string")
    refs = spark.createDataFrame([(1,), (3,)], "number long")
    got = {(r.code, r.detail) for r in audit.audit_documents(blocks, refs).collect()}
    assert got == {("citation_without_entry", "2"), ("entry_never_cited", "3"), ("invalid_numeric_citation_range", "d#5:descending"), ("table_without_caption", "1"), ("caption_sequence", "figure 2 missing"), ("caption_sequence", "figure 3 repeated")}
    status = {r.gate: r.status for r in audit.gates(audit.audit_documents(blocks, refs), ["bibliography", "figure_table_references", "manifest"]).collect()}
    assert status == {"bibliography": "fail", "figure_table_references": "fail", "manifest": "pass"}
    styles = spark.createDataFrame([("base", None, "10", "Arial"), ("mid", "base", None, "Times"), ("leaf", "mid", None, None)], "style string, parent string, size string, font string")
    assert {r.style: (r.size, r.font) for r in audit.effective_styles(styles, ["size", "font"]).collect()}["leaf"] == ("10", "Times")
    rows = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 2.0), ("m", 3, 2.0)], "m string, n int, v double")
    assert [r.n for r in audit.not_rising(rows, ["m"], "n", ["v"]).collect()] == [3]


def test_release_redaction_facts_and_poses(spark):
    df = spark.createDataFrame([(1, '{"n": 3, "rows": [1, 2], "deep": {"smiles": "C", "ok": [1, {"a": true}]}}')], "k int, j string")
    r = release.redact(df, "j").first()
    assert json.loads(r.j) == {"n": 3, "rows": "[redacted]", "deep": {"smiles": "[redacted]", "ok": [1, {"a": True}]}} and sorted(r.redactions) == ["/deep/smiles", "/rows"]
    facts = {(x.path, x.value) for x in release.scalar_facts(df, "k", "j", ("rows",)).collect()}
    assert facts == {("n", "3"), ("deep.smiles", "C"), ("deep.ok[0]", "1"), ("deep.ok[1].a", "true")}
    log = spark.createDataFrame([("l", " 1 -9.1 0.2 0.3 5.5"), ("l", " 2 -8.0 0.1 0.9 7.5"), ("l", "junk")], "lig string, value string")
    got = release.select_poses(release.read_poses(log, ["lig"]), ["lig"], 7.0).first()
    assert (got.m1, got.m2, got.m3, got.fragile) == (7.5, 7.5, 5.5, True)
    with pytest.raises(learning.DependencyUnavailable):
        chemistry.structure_function("scaffold")


def test_stage_states_batch_equals_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"run{r.randint(0, 4)}", r.randint(0, 4), i, r.choice(["accepted", "accepted", "changed", "noted"])) for i in range(150)]
    schema = "run string, stage int, sequence long, kind string"
    for k in range(3):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lifecycle.stream_stage_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "run", "stage", "sequence", "kind")
    q = stream.writeStream.outputMode("append").format("memory").queryName("stage_changes").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    # the files may come in any order, and so may their changes: the last state of each stage is one that a batch saw
    seen = {(x.run, x.stage) for x in spark.table("stage_changes").collect()}
    batch = lifecycle.stage_states(spark.createDataFrame(rows, schema), "run", "stage", "sequence", "kind").collect()
    assert seen == {(x.run, x.stage) for x in batch}
    jobs = spark.createDataFrame([("j1", 1, "RUNNING"), ("j1", 2, "COMPLETED"), ("j2", 1, "CANCELLED by 0"), ("j3", 1, "ODD")], "job string, at int, state string")
    cells = spark.createDataFrame([("c1", "h1"), ("c2", "h2"), ("c3", "h3")], "cell string, digest string")
    ledger = spark.createDataFrame([("c1", "h1", "complete"), ("c2", "old", "complete"), ("c3", "h3", "running")], "cell string, digest string, status string")
    reuse, redo = lifecycle.resumable(cells, ledger, ["cell"], "digest")
    assert [r.cell for r in reuse.collect()] == ["c1"] and sorted(r.cell for r in redo.collect()) == ["c2", "c3"]
    receipts = spark.createDataFrame([("j1", 3, "failed"), ("j4", 1, "succeeded")], "job string, at int, outcome string")
    assert {x.job: x.status for x in lifecycle.job_states(jobs, receipts, "job", "at", "state").collect()} == {"j1": "failed", "j2": "cancelled", "j3": "unknown", "j4": "succeeded"}


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = lifecycle.windowed(lifecycle.first_seen(stream, "ts", ["event_id"], "1 day"), "ts", ["event_type"], "1 day").writeStream.outputMode("append").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.w.start, r.event_type): r.n for r in lifecycle.windowed(events, "ts", ["event_type"], "1 day").collect()}
    got = {(r.w.start, r.event_type): r.n for r in spark.table("daily").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_staging_reads_back_and_drops(spark):
    stage = Staging(spark, "t")
    df = stage.put(spark.range(5), "x")
    assert df.count() == 5
    stage.drop("x")
    with pytest.raises(PySparkException):
        spark.read.parquet(f"{stage.root}/x").count()
