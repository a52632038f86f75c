import math
import random

from pyspark.sql import functions as F

from attesta.llm import topk


def slow(rows, k, divisor=7):
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i is not None and i % divisor == 0:
            near = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for n, (j, c) in enumerate(good) if n != at)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(near)]
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    monkeypatch.setattr(topk, "HEAD", 16)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1 + i % 3) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(700, None), (701, [float("nan")] * 12), (707, [None] + [1.0] * 11), (714, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(721, [0.0] * 12), (728, [1.0, 2.0]), rows[3], rows[7], rows[7], (7, [0.25] * 12), (735, []), (None, rows[14][1]), (None, rows[14][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x"))
    got = sorted((tuple(x) for x in topk.top_k(df, F.col("vec_id") % 7 == 0, 5).collect()), key=str)
    pad = [(i, v if v is None else [*v, *[0.0] * (12 - len(v))]) for i, v in rows]
    assert got == slow(pad, 5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    rows = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [3.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(x) for x in topk.top_k(rows, F.col("vec_id") % 100 == 0).collect()) == slow([(r.vec_id, r.embedding) for r in rows.collect()], 10, 100)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    empty = spark.createDataFrame([(0, []), (3, []), (5, []), (100, None)], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(x) for x in topk.top_k(empty, F.col("vec_id") % 100 == 0).collect()) == [(0, 1, 3, 0), (0, 2, 5, 0)]
