"""Operators that must hold at any size, against small plain forms."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import audit, documents, ledger, metrics, reconcile, similarity, splits, sweep


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_json_differences(spark):
    a = [(1, '{"x": [1, {"y": 2.50}], "e": [], "n": null}', "[C](O)", "k"), (2, '{"a": 1e2, "b": true}', None, "k"), (3, "{broken", "x", None), (4, "[]", "x", "k"), (None, '{"a~/b": 1}', "x", "k")]
    b = [(1, '{"n":null,"e":[],"x":[1.0,{"y":2.5}]}', "[C](O)", "k"), (2, '{"a": 100, "b": 1, "c": {"d": {}}}', "", "k"), (3, "{broken", "x", None), (5, "[]", "x", "k"), (None, '{"a~/b": "1"}', "x", "k")]
    schema = "id int, doc string, s string, path string"
    got = rows_of(documents.json_differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["id"], ["doc", "s", "path"]))
    assert got == sorted(
        [(2, "doc", "/b", "kind", "true", "1"), (2, "doc", "/c/d", "right_only", None, "{}"), (2, "s", "", "kind", "", ""), (4, "<row>", "", "left_only", None, None), (5, "<row>", "", "right_only", None, None), (None, "doc", "/a~0~1b", "kind", "1", "1")],
        key=repr,
    )
    deep = "[" * 40 + "7" + "]" * 40
    assert rows_of(documents.json_facts(spark.createDataFrame([(1, deep)], "k int, d string"), ["k"], "d")) == [(1, "/0" * 40, "number", "7")]
    odd = spark.createDataFrame([(1, None), (2, '{"a":1,"a":2}'), (3, "5"), (4, '{"skip":{"x":1},"y":[{"skip":2,"z":3}]}')], "k int, d string")
    assert rows_of(documents.json_facts(odd, ["k"], "d", skip=("skip",))) == [(2, "", "text", '{"a":1,"a":2}'), (3, "", "number", "5"), (4, "/y/0/z", "number", "3")]


def test_any_key_counts_makes_no_pairs(spark):
    from attesta.operators import joins

    r = random.Random(8)
    draw = lambda n, top: [(i, r.choice([None, *range(top)]), r.choice([None, *range(top)]), r.choice([None, *range(3)])) for i in range(n)]
    a, b = draw(90, 6), draw(40, 7)
    left, right = (spark.createDataFrame(x, f"{n} int, p int, q int, s int") for x, n in ((a, "l"), (b, "r")))
    pairs = [("p", "p"), ("q", "q"), ("s", "s")]
    want = Counter(y[0] for x in a for y in b if any(u is not None and u == v for u, v in zip(x[1:], y[1:], strict=True)))
    assert dict(rows_of(joins.any_key_counts(left, right, "r", pairs))) == want
    made = joins.any_key_join(left, right, "l", "r", pairs).groupBy("r").count()
    assert rows_of(made) == rows_of(joins.any_key_counts(left, right, "r", pairs))
    hot = spark.range(1_000_000).select(F.lit(1).alias("p"))  # 10 ** 12 pairs
    assert joins.any_key_counts(hot, spark.range(1_000_000).select("id", F.lit(1).alias("p")), "id", [("p", "p")]).agg(F.sum("n")).first()[0] == 10**12


def test_sweep_against_pairs(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), s, s + r.randint(-1, 6)) for s in (r.randint(0, 40) for _ in range(200))] + [("c", None, 4), ("d", 3, 3)]
    df = spark.createDataFrame(rows, "g string, s long, e long").withColumnRenamed("s", "from").withColumnRenamed("e", "to")
    real = [x for x in rows if x[1] is not None and x[1] < x[2]]
    times = Counter(real)
    others = {k: sum(x[0] == k[0] and x[1] < k[2] and k[1] < x[2] for x in real) - 1 for k in times}
    assert rows_of(sweep.overlap_counts(df, ["g"], "from", "to")) == sorted(((*k, n, others[k]) for k, n in times.items()), key=repr)
    pairs = Counter(a[0] for i, a in enumerate(real) for b in real[:i] if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert {x.g: int(x.pairs) for x in sweep.overlapping_pairs(df, ["g"], "from", "to").collect()} == dict(pairs)
    depth = lambda g, at: sum(x[0] == g and x[1] <= at < x[2] for x in real)
    profile = rows_of(sweep.depth_profile(df, ["g"], "from", "to"))
    assert all(depth(g, at) == d != depth(g, at - 1) for g, at, d in profile) and len(profile) > 40
    assert {x.g: (x.depth, x.at) for x in sweep.deepest(df, ["g"], "from", "to").collect()} == {g: max(((depth(g, at), -at) for at in range(60)))[:1] + (min(at for at in range(60) if depth(g, at) == max(depth(g, b) for b in range(60))),) for g in "ab"}


def test_many_intervals_over_one_place(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("g").alias("g"), (-F.col("id") - 1).alias("s"), (F.col("id") + 1).alias("e"))
    assert sweep.overlapping_pairs(df, ["g"], "s", "e").first().pairs == n * (n - 1) // 2
    assert tuple(sweep.deepest(df, ["g"], "s", "e").first()) == ("g", n, -1)


def test_ledger(spark):
    rows = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 5, "y", 1.0), ("b", 2, None, 2.0), ("b", 2, None, 2.0), (None, 3, "z", 3.0)], "k string, at int, status string, v double")
    flags = spark.createDataFrame([("a", 7, "late", None), ("a", 6, "early", "n"), ("b", 3, None, "m"), ("c", 1, "x", None)], "k string, at int, status string, note string")
    got = {x.k: x[1:] for x in ledger.laid_over(rows, flags, "k", ["at"], ["status", "note"]).collect()}
    assert got == {"a": ("late", 1.0, "n", 2), "b": (None, 2.0, "m", 1), None: ("z", 3.0, None, 0)}
    assert rows_of(ledger.ledger_problems(rows, flags, "k", ["status", "note"])) == [("a", "contradicted:status"), ("a", "rewritten"), ("c", "flag_without_row")]
    assert ledger.laid_over(rows.limit(0), flags, "k", ["at"], ["status"]).count() == 0


def test_ledger_problems_by_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "PART", 1000, raising=False)
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("a").alias("status"))
    rows = rows.unionByName(rows.withColumn("status", F.lit("b"))).unionByName(spark.createDataFrame([(None, "a")], "k long, status string"))
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("k"), F.col("id").cast("string").alias("status"))
    flags = hot.unionByName(spark.createDataFrame([(None, "x"), (-1, "x"), (-1, "x"), (8, None)], "k long, status string"))
    got = ledger.ledger_problems(rows, flags, "k", ["status"])
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2000
    rest = got.where("problem <> 'rewritten'")
    assert got.count() - 20_000 == 3 and rows_of(rest) == sorted([(None, "flag_without_row"), (-1, "flag_without_row"), (7, "contradicted:status")], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_stratified_folds_are_those_of_the_small_form(spark, seed):
    r = random.Random(seed)
    groups = [(f"g{i}", r.choice([0, 0, 1, 2, 9]), r.choice([0, 1, 1, 3])) for i in range(300)]
    rows = [(g, 0) for g, n, _ in groups for _ in range(n)] + [(g, 1) for g, _, p in groups for _ in range(p)]
    got = {x.g: x.fold for x in splits.stratified_fold_of(spark.createDataFrame(rows, "g string, y int"), "g", "y", 4, seed).collect()}
    assert got == splits.stratified_folds([g for g in groups if g[1] + g[2]], 4, seed)
    with pytest.raises(splits.InfeasibleSplit):
        splits.stratified_fold_of(spark.createDataFrame([("a", 1), ("b", 0)], "g string, y int"), "g", "y", 2, seed)


def test_a_million_groups_are_dealt_by_class(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = {(x.fold, x.positives): x.n for x in splits.stratified_fold_of(df, "g", "y", 5, 3).groupBy("fold", "positives").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[k, 1] - 333_334 / 5) <= 1 and abs(got[k, 0] - 666_666 / 5) <= 1 for k in range(5))


def test_draws_in_tasks(spark):
    groups = spark.range(500).select(F.concat(F.lit("g"), "id").alias("g"))
    draw = lambda df, block=64: sorted(map(tuple, metrics.draw_multiplicities(df, "g", 40, 9, block).collect()))
    got = draw(groups)
    assert got == draw(groups.repartition(7)) and got != draw(groups, 50)
    per = Counter()
    for rep, _, times in got:
        per[rep] += times
    assert set(per.values()) == {500} and len(per) == 40
    times = np.zeros((40, 500))
    for rep, g, t in got:
        times[rep, int(g[1:])] = t
    assert abs(times.var() - (1 - 1 / 500)) < 0.05 and times.mean(0).max() < 2 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert metrics.draw_multiplicities(groups.limit(0), "g", 3, 1).count() == 0


def test_bootstrap_intervals_hold_on_a_large_mean(spark):
    r = random.Random(1)
    rows = [(f"g{i % 200}", y + shift, y + shift + r.gauss(0, 0.5)) for i in range(1000) for y, shift in [(r.gauss(0, 1), 0.0)]]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    far = df.select("g", (F.col("y") + 1e9).alias("y"), (F.col("p") + 1e9).alias("p"))
    times = metrics.draw_multiplicities(df.select("g"), "g", 300, 5)
    near, off = ({x.metric: (x.lower, x.upper, x.valid) for x in metrics.bootstrap_intervals(d, "g", "y", "p", times).collect()} for d in (df, far))
    for m in ("mae", "rmse", "r2"):
        assert near[m][2] == 300 and near[m][:2] == pytest.approx(off[m][:2], abs=1e-4)
    plain = spark.createDataFrame(metrics.draws(sorted({x[0] for x in rows}), 300, 5), "rep long, g string, times long")
    by_numpy = {x.metric: (x.lower, x.upper) for x in metrics.bootstrap_intervals(df, "g", "y", "p", plain).collect()}
    for m in ("mae", "rmse", "r2"):
        assert near[m][:2] == pytest.approx(by_numpy[m], abs=0.02)


def test_weighted_regression_on_a_large_mean(spark):
    rows = spark.createDataFrame([("a", 1e9 + y, 1e9 + y + 0.5, w) for y, w in ((0.0, 1), (1.0, 2), (2.0, 0), (3.0, 1))] + [(None, 5.0, 5.0, 2)], "k string, y double, p double, w int")
    again = rows.select("k", "y", "p", F.explode(F.array_repeat(F.lit(1), F.col("w"))))
    got = {x.k: x for x in metrics.regression(rows, ["k"], "y", "p", "w").collect()}
    want = {x.k: x for x in metrics.regression(again, ["k"], "y", "p").collect()}
    for k in ("a", None):
        assert got[k].n == want[k].n and got[k].sst == pytest.approx(want[k].sst, abs=1e-6) and got[k].r2 == (None if want[k].r2 is None else pytest.approx(want[k].r2))


def test_wide_gaps_are_one_row(spark):
    got = rows_of(audit.gaps_and_repeats(spark.createDataFrame([("f", 2), ("f", 2), ("f", 999_999_999), ("t", 1), ("u", None)], "kind string, number long"), "kind", "number"))
    assert got == [("f", "missing", 1, 1), ("f", "missing", 3, 999_999_998), ("f", "repeated", 2, 2)]


def test_ordered_digest_deals_a_group_once(spark):
    rows = spark.range(3000).select(F.lit("g").alias("g"), "id").unionByName(spark.range(5).select(F.lit("h").alias("g"), "id"))
    got = reconcile.ordered_digest(rows, ["g"], F.col("id").cast("string"), ["id"], block=100)
    assert [(r.g, r.n) for r in got.orderBy("g").collect()] == [("g", 3000), ("h", 5)]
    assert "BroadcastHashJoin" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan


def test_scores_are_held_in_parts(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    search = lambda: rows_of(similarity.cosine_top_k(df.where("id < 40"), df, 3, "id", "v").select("query_id", "rank", "ref_id"))
    whole, seen = search(), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(similarity, "SCORES", 40 * 7)
    plain = similarity._nearest

    def small(score, ids, k):
        seen.add(1)
        assert score.size <= 40 * 7
        return plain(score, ids, k)

    monkeypatch.setattr(similarity, "_nearest", small)
    assert search() == whole and seen.value >= 300 // 7
