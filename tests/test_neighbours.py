import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from attesta.operators import learning, neighbours


def _rows(n, seed=1):
    r = random.Random(seed)
    return [(i, i % 3, int(r.random() < 0.25), float(r.randint(0, 9)), r.random(), r.random()) for i in range(n)]


def _slow(queries, refs, k, apart):
    out = {}
    for q, x in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), r) for r, y in refs if not (apart and r == q))
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("apart", [True, False])
def test_nearest_is_brute_force(spark, monkeypatch, apart):
    monkeypatch.setattr(neighbours, "BLOCK", 37)
    rows = [(i, [a, b]) for i, _, _, a, b, _ in _rows(160)] + [(500, [3.0, 0.5]), (501, [3.0, 0.5])]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    got = {r.id: [(n.distance, n.id) for n in r.near] for r in neighbours.nearest(df, df, 4, apart).collect()}
    want = _slow(rows, rows, 4, apart)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]])
    assert all(r.near == [] for r in neighbours.nearest(df, df.limit(0), 3).collect())


def test_blocks_meet_few_others(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "LEAF", 256)
    met, put = [], neighbours.Staging.put

    def counted(self, df, name):
        out = put(self, df, name)
        met.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(neighbours.Staging, "put", counted)
    r = random.Random(5)
    rows = [(i, [r.random() * 90, float(r.randint(0, 9))]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {x.id: [n.id for n in x.near] for x in neighbours.nearest(df, df, 3, True).collect()}
    x = np.array([v for _, v in rows])
    for i in range(0, 4000, 97):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert got[i] == np.lexsort((np.arange(4000), d))[:3].tolist()
    assert len(got) == 4000 and met and met[0] < 4000  # of over 125 * 125 pairs of blocks


def test_meetings_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "MEETINGS", 8, raising=False)
    seen, map_in = [], type(spark.range(1)).mapInPandas

    def counted(self, f, schema, *more, **named):
        if "fars" in self.columns:
            seen.append(max(r["count"] for r in self.groupBy(F.spark_partition_id()).count().collect()))
        return map_in(self, f, schema, *more, **named)

    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", counted)
    df = spark.range(1000).select("id", F.array(F.rand(3), F.rand(4)).alias("x"))
    assert neighbours.nearest(df, df, 3, True).count() == 1000
    assert seen and max(seen) < 5 * 8


def test_copies_are_neighbours_by_id(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(99, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(4)
    got = {r.id: [(n.distance, n.id) for n in r.near] for r in neighbours.nearest(df, df, 3, True).collect()}
    assert got == _slow(rows[:60], rows[:60], 3, True) | {99: []}


def test_estimator_is_saved_and_leaks_nothing(spark, tmp_path):
    df = spark.createDataFrame(_rows(120), "id long, fold int, y int, a double, b double, c double")
    make = lambda: learning.pipeline(["a", "b"], learning.estimator("knn_classifier", k=3), "y", classify=True)
    model = make().fit(df.where("fold <> 0"))
    model.write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    score = lambda m, rows: {r.id: (r.prediction, r.probability[1]) for r in m.transform(rows).select("id", "prediction", "probability").collect()}
    assert score(model, df) == score(again, df) and len(score(again, df)) == 120
    scaled = {r.id: r.x.toArray() for r in model.transform(df).select("id", F.col("__scaled").alias("x")).collect()}
    labels = {i: y for i, _, y, *_ in _rows(120)}
    train = [(i, scaled[i]) for i, f, *_ in _rows(120) if f]
    near = _slow([(i, scaled[i]) for i in scaled], train, 3, False)
    assert {i: p for i, (_, p) in score(model, df).items()} == pytest.approx({i: np.mean([labels[j] for _, j in n]) for i, n in near.items()})
    # a row's own fold doesn't speak: turning its labels over changes no prediction of it
    turned = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    of = lambda rows: {r.id: r.prediction for r in learning.out_of_fold(rows, 3, "fold", make, "id").where("fold = 0").collect()}
    assert of(df) == of(turned)


def test_rows_that_repeat_speak_as_often_as_they_stand(spark):
    rows = spark.createDataFrame([(0.0, 1.0)] * 3 + [(1.0, 4.0), (5.0, 9.0)], "a double, y double")
    model = learning.pipeline(["a"], learning.estimator("knn", k=4), "y").fit(rows)
    assert {r.a: r.prediction for r in model.transform(rows.distinct()).collect()} == {0.0: pytest.approx(7 / 4), 1.0: pytest.approx(7 / 4), 5.0: pytest.approx((9 + 4 + 1 + 1) / 4)}


def test_new_minority_rows_stay_on_their_side(spark):
    rows = _rows(150)
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, c double")
    got = neighbours.minority_rows(df, "id", "fold", 3, "y", ["a", "b", "c"], 4, 11).collect()
    again = neighbours.minority_rows(df.repartition(5), "id", "fold", 3, "y", ["a", "b", "c"], 4, 11).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    of = {r[0]: r for r in rows}
    for t in range(3):
        train = [r for r in rows if r[1] != t]
        ones = [r for r in train if r[2] == 1]
        new = [x for x in got if x.training_of == t]
        assert len(new) == len(train) - 2 * len(ones)
        for x in new:
            p, o = of[x.parent], of[x.other]
            assert p[1] != t and o[1] != t and p[2] == o[2] == x.y == 1 and p != o
            near = sorted((np.linalg.norm(np.array(p[3:]) - np.array(r[3:])), r[0]) for r in ones if r != p)[:4]
            assert o[0] in [i for _, i in near]
            at, a, b = np.array([x.a, x.b, x.c]), np.array(p[3:]), np.array(o[3:])
            u = (at - a) @ (b - a) / ((b - a) @ (b - a))
            assert 0 <= u < 1 and np.allclose(at, a + u * (b - a))
    assert neighbours.minority_rows(df.where("y = 1"), "id", "fold", 3, "y", ["a"], 4, 1).count() == 0
